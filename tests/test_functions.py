import pytest
from pyspark.sql import functions as F

from lexloom.functions import chunks, metrics, prompts, training
from lexloom.functions import text as T
from lexloom.functions.jurisdictions import jurisdiction


def one(spark, column, **values):
    names = list(values)
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{n} {'array<string>' if isinstance(values[n], list) else 'string'}" for n in names))
    return df.select(column.alias("x")).first().x


def test_cleaning(spark):
    assert one(spark, T.clean_whitespace(F.col("t")), t="  a \t b \r\n c​ \x0b d\f\n\n\n e  \n") == "a b\nc\nd\n\ne"
    assert one(spark, T.drop_page_lines(F.col("t")), t="a\n- 12 -\nPage 3 of 9\nb\n12345") == "a\n\nb\n12345"
    assert one(spark, T.fingerprint(F.col("t")), t=" A \n b") == one(spark, T.fingerprint(F.col("t")), t="a b")
    assert one(spark, T.tokens(F.col("t")), t="Déjà-vu, 2 x_y!") == ["déjà", "vu", "2", "x_y"]


def test_chunks_are_slices_and_bounded():
    text = "Intro.\n\n" + "\n".join(f"{k}. Clause\n{k}.1 The party shall pay. (a) first; " + "Mr. Smith v. Jones said so. " * 20 for k in range(1, 9))
    for options in ({"size": 64}, {"size": 100, "overlap": 0}, {"size": 50, "sections": False}, {"size": 50, "paragraphs": False, "least": 0}):
        chunker = chunks.Chunker(**options)
        found = chunker.chunks(text)
        assert all(text[c.start_char : c.end_char] == c.text and c.text == c.text.strip() for c in found)
        assert all(len(c.text) <= 4 * (chunker.size + chunker.least) for c in found)
        covered = set().union(*(range(c.start_char, c.end_char) for c in found))
        assert all(k in covered or text[k].isspace() for k in range(len(text)))
    assert chunks.Chunker().chunks(" \n ") == []
    assert chunks.Chunker(size=20, overlap=0, least=0).chunks("1. Terms\nx\n2. Fees\n" + "y " * 40)[0].section == "1. Terms"
    for bad in ({"size": 0}, {"overlap": 512}, {"overlap": -1}, {"least": 513}):
        with pytest.raises(ValueError):
            chunks.Chunker(**bad)


def test_prompts(spark):
    make = lambda **o: one(spark, prompts.instruction_format(F.col("i"), F.col("r"), F.col("c"), **o), i="Do", r="Done", c="Ctx")
    assert make().endswith("### Instruction:\nDo\n\n### Input:\nCtx\n\n### Response:\nDone")
    assert make(template="chatml", system="S") == "<|im_start|>system\nS<|im_end|>\n<|im_start|>user\nDo\n\nCtx<|im_end|>\n<|im_start|>assistant\nDone<|im_end|>"
    assert make(template="{{x}} {instruction}: {response} ({context})") == "{x} Do: Done (Ctx)"
    assert one(spark, prompts.instruction_format(F.col("i"), template="{instruction} > {response} <"), i="Do") == "Do > "
    with pytest.raises(ValueError):
        make(template="none")
    assert [m.role for m in one(spark, prompts.messages(F.col("c"), F.col("i"), F.col("r"), "S"), c="C", i="I", r="")] == ["system", "user", "assistant"]
    assert one(spark, prompts.training_text(F.col("c"), F.col("i"), F.col("r")), c="raw", i="", r="x") == "raw"


def test_metrics(spark):
    f1 = lambda a, b: one(spark, metrics.token_f1(F.col("a"), F.col("b")), a=a, b=b)
    assert f1("", "") == 1 and f1("x", "") == 0 and f1("the the cat", "the cat sat") == pytest.approx(2 / 3)
    assert metrics.lcs_length("a b c d".split(), "b x d a".split()) == 2 and metrics.lcs_length([], ["a"]) == 0
    like = one(spark, metrics.similarity(F.col("a"), F.col("b")), a="a b c", b="a c")
    assert like.rouge_l == pytest.approx(0.8) and like.bigram_overlap == 0
    assert one(spark, metrics.rouge_l(F.col("a"), F.col("b")), a="a b c", b="a c").f1 == pytest.approx(0.8)
    assert one(spark, metrics.terminology(F.col("t")), t="Breach of a duty  of care").terms_used == ["breach"]
    q = one(spark, metrics.quality(F.col("t")), t="It may be so. First, see:\n1. this.")
    assert (q.word_count, q.sentence_count, q.has_structure, q.hedging_score) == (8, 3, True, 1.0)
    s = one(spark, metrics.citation_scores(F.col("a"), F.col("b")), a=[], b=[])
    assert (s.precision, s.recall, s.f1) == (1, 1, 1)
    assert one(spark, metrics.canonical(F.col("e")), e=["[2020]  uksc 1", "a  b"]) == ["[2020] UKSC 1", "a b"]
    g = one(spark, metrics.grounding(F.array(F.lit("Theft Act 1968"), F.lit("[2020] UKSC 1")), F.col("t")), t="See section 1 of the Theft Act 1968.")
    assert (g.grounded, g.ungrounded, g.grounding_rate) == (["Theft Act 1968"], ["[2020] UKSC 1"], 0.5)
    assert one(spark, metrics.chosen_option(F.col("a"), F.col("o")), a="Law: governing law!", o=["governing", "governing law", "term"]) == "governing law"


def test_courts_and_models(spark):
    level = lambda code, c: one(spark, jurisdiction(code).court_level(F.col("c")), c=c)
    assert [level("uk", c) for c in (" ewca civ ", "House of Lords", "Moot")] == [2, 0, 8]
    assert [level("us", c) for c in ("2d Cir.", "D. Mass.", "Bankr. D. Del.")] == [1, 3, 4] and level("eu", "CFI") == 1
    assert jurisdiction("UK").is_legal_term("Tort")
    with pytest.raises(ValueError):
        jurisdiction("fr")
    assert one(spark, training.parameters(F.col("m")), m="x-8x7B") == 56_000_000_000 and one(spark, training.parameters(F.col("m")), m="gpt2") is None
    assert one(spark, training.target_modules(F.col("m")), m="gpt2") == ["c_attn", "c_proj", "c_fc"]


def test_training_settings(tmp_path):
    c = training.TrainingConfig(task="contract_review", seed=7)
    assert (c.num_epochs, c.max_seq_length, c.optim, c.use_4bit, c.lora_target_modules[0]) == (5, 4096, "paged_adamw_32bit", True, "q_proj") and "num_epochs" in c.derived
    c.save(str(tmp_path / "x" / "c.json"))
    assert training.TrainingConfig.load(str(tmp_path / "x" / "c.json")) == c
    record = c.to_dict() | {"method": "lora", "task": "general", "optim": "sgd"}
    again = training.TrainingConfig.from_dict(record)
    assert (again.num_epochs, again.optim, again.use_4bit, again.seed) == (3, "sgd", False, 7) and "hub_token" not in record
    assert training.TrainingConfig.of_task("citation_extraction").max_seq_length == 1024 and len(training.SETTINGS) == 43
    for bad in ({"task": "x"}, {"method": "x"}, {"jurisdiction": "fr"}, {"batch_size": 0}, {"learning_rate": 0}, {"warmup_ratio": 1}, {"fp16": True}, {"use_4bit": True, "method": "lora"}, {"lora_r": 0}, {"colour": 1}):
        with pytest.raises(ValueError):
            training.TrainingConfig(**bad)
    assert training.TrainingConfig(method="full", lora_r=0).lora_r == 0


@pytest.mark.parametrize(
    ("text", "options", "marks"),
    [
        ("2.1 The Lessor shall insure the premises against fire.\n\n2.2 The Lessee shall pay the premium on demand each year.\n\n(b) Unpaid sums bear interest from the due date.", {"size": 20, "overlap": 0}, ["2.1", "2.2", "(b)"]),
        ("  3) Keep the garden.\n\n  4) Mend the fence along the lane before winter comes.", {"size": 14, "overlap": 0, "least": 0}, ["3)", "4)"]),
    ],
)
def test_chunks_bear_markers(text, options, marks):
    assert [c.paragraph for c in chunks.Chunker(**options).chunks(text)] == marks


def test_chunks_of_sentences_and_sections():
    t = "Mrs. Hale cited reg. 4 and U.K. law. The panel agreed."
    assert [t[a:b].strip() for a, b in chunks.pieces(chunks.sentence_starts(t, 0, len(t)), 0, len(t))] == ["Mrs. Hale cited reg. 4 and U.K. law.", "The panel agreed."]
    long = "PART 7\nTerms apply.\n\nPART 8\n" + "The buyer shall collect. " * 30
    found = chunks.Chunker(size=40, overlap=0).chunks(long)
    assert (found[0].section, found[-1].section) == ("PART 7", "PART 8")
    eu = chunks.Chunker(size=8, overlap=0, least=0, jurisdiction="eu").chunks("Article 4\nScope here.\n\nArticle 5\nAims.")
    assert [c.section for c in eu] == ["Article 4", "Article 5"]
    words = chunks.Chunker(size=50, overlap=0).chunks("term " * 400)
    assert len(words) > 1 and all(set(c.text.split()) == {"term"} for c in words)
    with_rest = chunks.Chunker(size=100, overlap=0, least=10).chunks("The owner agrees to sell the field. " * 11 + "\n\nSigned.")
    assert with_rest[-1].text.endswith("Signed.") and with_rest[-1].text != "Signed."
    apart = chunks.Chunker(size=30, overlap=5).chunks(long)
    assert all(b.start_char < a.end_char and long[b.start_char - 1].isspace() for a, b in zip(apart, apart[1:], strict=False) if b.start_char)
