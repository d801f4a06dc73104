import json

import pytest
from pyspark.sql import functions as F

from lexloom.operators import benchmark, dataset
from lexloom.sources import corpus


def samples(spark, *rows):
    data = [(k, r.get("text", ""), r.get("instruction"), r.get("response"), r.get("type", "unknown"), r.get("place"), r.get("source"), r.get("meta", {})) for k, r in enumerate(rows)]
    return spark.createDataFrame(data, "pos long, text string, instruction string, response string, document_type string, jurisdiction string, source string, metadata map<string,string>")


def test_dedup_and_statistics(spark):
    df = samples(spark, {"text": "A  b"}, {"text": "a B "}, {"text": "c", "instruction": "i", "response": ""}, {"text": "c"})
    assert sorted(r.pos for r in dataset.deduplicate(df).collect()) == [0, 2, 3]
    s = dataset.statistics(df).first()
    assert (s.num_samples, s.num_instructions, s.total_chars, s.min_chars, s.max_chars, s.jurisdictions) == (4, 1, 11, 1, 4, {"unknown": 4})
    assert dataset.statistics(df.limit(0)).first().num_samples == 0
    assert sorted(r.pos for r in dataset.shuffled(df).collect()) == [0, 1, 2, 3]


def test_split(spark):
    df = spark.range(10).select(F.col("id").alias("pos"), (F.col("id") % 3).alias("g"))
    counts = {r.split: r["count"] for r in dataset.split(df).groupBy("split").count().collect()}
    assert counts == {"train": 8, "validation": 1, "test": 1}
    assert all(r.n == 1 for r in dataset.split(df, group=F.col("g")).groupBy("g").agg(F.count_distinct("split").alias("n")).collect())
    assert {r.split for r in dataset.split(df, 1.0, 0.0, 0.0).collect()} == {"train"}
    uneven = spark.createDataFrame([(k, g) for k, g in enumerate("a" * 6 + "b" * 4 + "c" * 4)], "pos long, g string")
    sizes = sorted(r["count"] for r in dataset.split(uneven, 0.5, 0.25, 0.25, group="g").groupBy("split").count().collect())
    assert sizes == [4, 4, 6]
    assert {r.split for r in dataset.split(spark.range(7).toDF("pos"), 0.5, 0.5, 0.0).collect()} == {"train", "validation"}
    by_key = spark.createDataFrame([(k, {"document_id": str(k // 4)}) for k in range(20)], "pos long, metadata map<string,string>")
    homes = dataset.split(by_key, 0.6, 0.2, 0.2, group="document_id").groupBy(F.col("metadata")["document_id"].alias("d")).agg(F.count_distinct("split").alias("n"), F.first("split").alias("s")).collect()
    assert len(homes) == 5 and all(r.n == 1 for r in homes) and len({r.s for r in homes}) == 3
    with pytest.raises(ValueError):
        dataset.split(df, 0.5, 0.1, 0.1)


@pytest.mark.parametrize("shuffle", [True, False])
def test_split_of_many_units(spark, shuffle):
    """Small units: every row has a split, groups stay whole, and the shares are held closely; one large group is dealt by the same rule."""
    df = spark.range(30000).select(F.col("id").alias("pos"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("g"), (F.col("id") / 7).cast("int"))).alias("g"))
    out = dataset.split(df, 0.6, 0.3, 0.1, shuffle=shuffle, group="g").cache()
    counts = {r.split: r["count"] for r in out.groupBy("split").count().collect()}
    assert sum(counts.values()) == 30000 and all(abs(counts[s] - 30000 * share) < 50 for s, share in (("train", 0.6), ("validation", 0.3), ("test", 0.1)))
    assert out.groupBy("g").agg(F.count_distinct("split").alias("n")).filter("n > 1").count() == 0
    rows = {r.split: r["count"] for r in dataset.split(df, shuffle=shuffle).groupBy("split").count().collect()}
    assert rows == {"train": 24000, "validation": 3000, "test": 3000}


def test_places(spark):
    df = samples(spark, *({"text": t} for t in "abcde"))
    texts = lambda out: [r.text for r in out.orderBy("pos").collect()]
    assert texts(dataset.at(df, 1)) == ["b"] and texts(dataset.at(df, -1)) == ["e"] and texts(dataset.at(df, 9)) == []
    assert texts(dataset.between(df, 1, 3)) == ["b", "c"] and texts(dataset.between(df, -2)) == ["d", "e"] and texts(dataset.between(df, 0, -3)) == ["a", "b"]
    assert texts(dataset.extended(df, samples(spark, {"text": "x"}, {"text": "y"}))) == list("abcdexy")
    assert texts(dataset.extended(df.limit(0), df)) == list("abcde")


def test_dedup_of_rows_in_one_place(spark):
    rows = spark.createDataFrame([(0, "a"), (0, "b"), (1, "A"), (2, "b")], "pos long, text string")
    assert sorted((r.pos, r.text) for r in dataset.deduplicate(rows, "text").collect()) == [(0, "a"), (0, "b")]


def test_training_rows(spark):
    df = samples(spark, {"text": "Raw."}, {"instruction": "Q", "response": "A"}, {"text": "x" * 50})
    texts = [r.text for r in dataset.rendered(df).collect()]
    assert texts[0] == "Raw." and texts[1].endswith("### Response:\nA") and dataset.too_long(df, 10).count() == 1
    assert dataset.rendered(df.filter("instruction is not null"), "messages").first().messages[0].role == "user"
    with pytest.raises(ValueError):
        dataset.training_rows(df.limit(0))
    named = dataset.training_rows(samples(spark, {"text": "Mr Lee paid."}), anonymise=True)
    assert named.first().text == "[PERSON_1] paid."


def test_processing_statistics(spark):
    docs = spark.createDataFrame([("Mr Lee  cites [2020] uksc 1 and the Theft Act 1968.",), ("",)], "text string")
    one, none = (r.statistics for r in dataset.processing_statistics(dataset.processed(docs, anonymise=True, chunk=True)).collect())
    assert (one.citation_count, one.citations_by_type, one.citations_by_jurisdiction, one.chunk_count, one.entities_anonymised, one.unique_entities) == (2, {"case": 1, "legislation": 1}, {"uk": 2}, 1, 1, 1)
    assert one.original_chars == 51 and none.reduction_pct == 0 and none.citations_by_type == {}
    chunk = dataset.chunk_records(spark.createDataFrame([("n", "1. Terms\nx y")], "source string, text string")).first()
    assert (chunk.text, chunk.source, chunk.chunk_index, chunk.section) == ("1. Terms\nx y", "n", 0, "1. Terms")


def test_preprocess_and_chunk(spark):
    df = samples(spark, {"text": "Mr Lee  cites [2020] uksc 1.", "instruction": "Ask Mr Lee", "response": "ok", "meta": {"who": '"Mr Lee"'}}, {"text": " "}, {"text": "One. " * 200, "source": "s"})
    first = dataset.preprocessed(df, jurisdiction="uk").orderBy("pos").first()
    assert (first.text, first.instruction, first.metadata["who"], first.metadata["citation_count"], first.jurisdiction) == ("[PERSON_1] cites [2020] UKSC 1.", "Ask [PERSON_1]", '"[PERSON_1]"', "1", "uk")
    out = dataset.chunked(df, size=100, overlap=0).collect()
    assert {r.pos for r in out} == {0, 2}
    parts = [r for r in out if r.pos == 2]
    assert len(parts) == int(parts[0].metadata["chunk_count"]) > 1 and parts[0].metadata["document_id"] == '"s#2"'
    done = dataset.processed(spark.createDataFrame([("Mr Lee [2020] uksc 1",)], "text string"), anonymise=True, chunk=True).first()
    assert done.processed == "[PERSON_1] [2020] UKSC 1" and len(done.chunks) == 1 and done.citations[0].page == "1"


def test_loading(spark, tmp_path):
    (tmp_path / "contracts").mkdir()
    (tmp_path / "contracts" / "a.txt").write_text("A contract.")
    (tmp_path / "b.jsonl").write_text('{"instruction": "i", "input": "x", "output": "y", "k": 1}\n\n{"text": ["p", "q"], "metadata": {"z": [1]}}\n')
    (tmp_path / "c.json").write_text(json.dumps({"data": [{"question": "q", "answer": "a"}]}))
    (tmp_path / ".hidden.txt").write_text("no")
    rows = corpus.load(spark, str(tmp_path)).orderBy("pos").collect()
    assert [(r.source, r.text, r.instruction, r.response) for r in rows] == [("b.jsonl#1", "x", "i", "y"), ("b.jsonl#3", "p\n\nq", None, None), ("c.json#1", "", "q", "a"), ("contracts/a.txt", "A contract.", None, None)]
    assert rows[0].metadata == {"k": "1"} and rows[1].metadata == {"z": "[1]"} and rows[3].document_type == "contract"
    assert corpus.load(spark, str(tmp_path / "b.jsonl"), limit=1).count() == 1
    (tmp_path / "d.jsonl").write_text('{"a": 1}\nnot json\n')
    with pytest.raises(Exception, match="d.jsonl#2"):
        corpus.load(spark, str(tmp_path / "d.jsonl")).collect()
    (tmp_path / "x.pdf").write_text("x")
    with pytest.raises(ValueError):
        corpus.load(spark, str(tmp_path / "x.pdf"))
    with pytest.raises(FileNotFoundError):
        corpus.load(spark, str(tmp_path / "none.jsonl"))
    assert corpus.load(spark, str(tmp_path), recursive=False, kinds=("json", "txt")).count() == 1
    corpus.write_jsonl(corpus.load(spark, str(tmp_path / "b.jsonl")), str(tmp_path / "out"), 1)
    lines = [json.loads(x) for p in (tmp_path / "out").glob("part-*") for x in p.read_text().splitlines()]
    assert lines[0]["metadata"] == {"k": 1} and "jurisdiction" not in lines[0]


def test_lines_of_many_blocks(spark, tmp_path):
    """Numbers run on over the blocks in which a file is read, blank lines counted."""
    lines = ["" if k % 5 == 2 else json.dumps({"text": f"line {k} " + "x" * (k % 40)}) for k in range(4000)]
    (tmp_path / "a.jsonl").write_text("\n".join(lines) + "\n")
    (tmp_path / "b.jsonl").write_text("\n".join(lines[:7]))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
        out = corpus.load(spark, str(tmp_path)).select("pos", "text", "source").orderBy("pos").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    wanted = [(json.loads(x)["text"], f"{f}.jsonl#{k + 1}") for f, own in (("a", lines), ("b", lines[:7])) for k, x in enumerate(own) if x]
    assert [(r.text, r.source) for r in out] == wanted and [r.pos for r in out] == list(range(len(wanted)))


def test_tables_as_sources(spark):
    rows = spark.createDataFrame([(0, "c1", 3), (1, "", 4), (2, "c2", 5)], "id long, context string, label int")
    got = corpus.from_table(rows, "id", limit=2, source="hub/id").orderBy("pos").collect()
    assert [(r.text, r.metadata, r.source) for r in got] == [("c1", {"label": "3"}, "hub/id"), ("c2", {"label": "5"}, "hub/id")]
    assert corpus.from_table(rows.withColumnRenamed("context", "opinion"), "id", text_field="opinion").count() == 2
    with pytest.raises(KeyError):
        corpus.from_table(rows, "id", text_field="none")
    with pytest.raises(ValueError):
        corpus.from_table(rows.select("id", "label"), "id")


def test_benchmark(spark):
    qa = spark.createDataFrame([("Q", ["thirty days"], "Thirty days."), ("Q", ["ten"], "none")], "question string, answers array<string>, response string")
    got = benchmark.contract_qa(qa)[1].first()
    assert (got.exact_accuracy, got.partial_accuracy, got.samples) == (0.5, 0.5, 2)
    cite = spark.createDataFrame([("p", ["[2020] UKSC 1"], "see [2020] uksc 1", "")], "prompt string, citations array<string>, response string, context string")
    table, skipped = benchmark.evaluate({"contract_qa": qa, "citation_accuracy": cite})
    values = {(r.task, r.metric): r.value for r in table.collect()}
    assert values["citation_accuracy", "f1"] == 1 and ("citation_accuracy", "grounding_rate") not in values and len(skipped) == 4
    with pytest.raises(ValueError):
        benchmark.checked(spark.createDataFrame([("Q", [])], "question string, answers array<string>"), "contract_qa")
    assert benchmark.answered(qa.drop("response"), "contract_qa", lambda p: p[:3]).first().response == "Con"
