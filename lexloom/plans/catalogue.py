"""Every registered query of the library with its SQL. Legal text is built from the columns of ``orders`` and others, alike in both."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.functions import chunks, citations, metrics, pii, prompts, training
from lexloom.functions import text as T
from lexloom.functions.jurisdictions import jurisdiction
from lexloom.operators import benchmark, dataset
from lexloom.sources import corpus

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _built(spark: SparkSession, d: str, form: str) -> DataFrame:
    """orders with o_orderkey, y (year), n (1 to 500), p (1 to 90) and a text by a SQL expression of them."""
    base = dataset.dealt(_t(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate")).selectExpr("o_orderkey", "o_custkey", "year(o_orderdate) AS y", "o_orderkey % 500 + 1 AS n", "o_custkey % 90 + 1 AS p")
    return base.withColumn("text", F.expr(form))


_BASE = "(SELECT o_orderkey, o_custkey, year(o_orderdate)::INT AS y, o_orderkey % 500 + 1 AS n, o_custkey % 90 + 1 AS p FROM orders)"
_OPINION = "concat('As held in Alpha v Beta [', CAST(y AS STRING), '] UKSC ', CAST(n AS STRING), ' at [', CAST(p AS STRING), '].')"


def _cited(df: DataFrame, unique: bool = True) -> DataFrame:
    return df.select("*", F.explode(citations.citations_of(F.col("text"), unique)).alias("c"))


@query(f"SELECT 'UKSC' AS court, y AS year, count(*) AS n_citations FROM {_BASE} GROUP BY y")
def neutral_citation_counts(spark, d):
    return _cited(_built(spark, d, _OPINION)).groupBy(F.col("c.court").alias("court"), F.col("c.year").alias("year")).agg(F.count("*").alias("n_citations"))


@query(f"SELECT o_orderkey, length('As held in Alpha v Beta ') AS start, length('As held in Alpha v Beta [' || y || '] UKSC ' || n) AS stop, '[' || y || '] UKSC ' || n AS normalised, 'Alpha v Beta' AS parties, p::VARCHAR AS paragraph FROM {_BASE}")
def citation_offsets(spark, d):
    return _cited(_built(spark, d, _OPINION)).select("o_orderkey", F.col("c.start").alias("start"), F.col("c.end").alias("stop"), "c.normalised", "c.parties", "c.paragraph")


@query(f"SELECT o_orderkey, 'Alpha v Beta' AS parties, count(*) AS n FROM {_BASE}, range(2) GROUP BY o_orderkey")
def parallel_citations(spark, d):
    form = "concat('In Alpha v Beta [', CAST(y AS STRING), '] UKSC ', CAST(n AS STRING), ', [', CAST(y AS STRING), '] 1 AC ', CAST(n AS STRING), ' it was held.')"
    return _cited(_built(spark, d, form)).groupBy("o_orderkey", F.col("c.parties").alias("parties")).agg(F.count("*").alias("n"))


@query(f"SELECT o_orderkey, 'Companies Act ' || y || ', s ' || n AS normalised, 's ' || n AS provision, 'Companies Act ' || y AS instrument, y AS year FROM {_BASE}")
def legislation_references(spark, d):
    form = "concat('Under section ', CAST(n AS STRING), ' of the Companies Act ', CAST(y AS STRING), ' it applies.')"
    return _cited(_built(spark, d, form)).select("o_orderkey", "c.normalised", "c.provision", "c.instrument", F.col("c.year").alias("year"))


@query(f"SELECT o_orderkey, unnest([n || ' U.S. ' || p, '42 U.S.C. § ' || n]) AS normalised, unnest(['case', 'legislation']) AS type, unnest([y, 0]) AS year FROM {_BASE}")
def us_references(spark, d):
    form = "concat('See Roe v. Doe, ', CAST(n AS STRING), ' U.S. ', CAST(p AS STRING), ' (', CAST(y AS STRING), ') and 42 U.S.C. § ', CAST(n AS STRING), '.')"
    return _cited(_built(spark, d, form)).select("o_orderkey", "c.normalised", "c.type", F.coalesce("c.year", F.lit(0)).alias("year"))


@query(f"SELECT o_orderkey, unnest(['Case C-' || n || '/' || right(y::VARCHAR, 2), 'Art ' || p || ' TFEU', 'Regulation (EU) ' || y || '/' || n]) AS normalised FROM {_BASE}")
def eu_references(spark, d):
    form = "concat('In Case C-', CAST(n AS STRING), '/', right(CAST(y AS STRING), 2), ' on Article ', CAST(p AS STRING), ' TFEU and Regulation (EU) ', CAST(y AS STRING), '/', CAST(n AS STRING), '.')"
    return _cited(_built(spark, d, form)).select("o_orderkey", "c.normalised")


@query(f"SELECT o_orderkey, 'Compare [' || y || '] UKSC ' || n || ' with (' || y || ') 3 App Cas ' || p || '.' AS text FROM {_BASE}")
def citations_normalised(spark, d):
    form = "concat('Compare [', CAST(y AS STRING), ']  uksc ', CAST(n AS STRING), ' with (', CAST(y AS STRING), ')  3 App  Cas ', CAST(p AS STRING), '.')"
    return _built(spark, d, form).select("o_orderkey", citations.with_normal_citations(F.col("text")).alias("text"))


@query("SELECT doc_id, length(trim(regexp_replace(regexp_replace(text, '[ \\t]+', ' ', 'g'), ' ?\\n ?', chr(10), 'g'), ' ' || chr(10))) AS n FROM (SELECT doc_id, regexp_replace(text, '\\n{3,}', chr(10) || chr(10), 'g') AS text FROM documents)")
def clean_whitespace_lengths(spark, d):
    return _t(spark, d, "documents").select("doc_id", F.char_length(T.clean_whitespace(F.col("text"))).cast("long").alias("n"))


@query(f"SELECT o_orderkey, 'Clause one.' || chr(10) || chr(10) || 'Clause two.' AS text FROM {_BASE}")
def page_lines_dropped(spark, d):
    form = "concat('Clause one.\\n', CAST(p AS STRING), '\\nPage ', CAST(p AS STRING), ' of 90\\nClause two.')"
    return _built(spark, d, form).select("o_orderkey", T.drop_page_lines(F.col("text")).alias("text"))


_FOLD = "lower(trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')))"


@query(f"SELECT min(doc_id) AS doc_id, sha256({_FOLD}) AS fp FROM documents GROUP BY 2")
def exact_dedup(spark, d):
    return dataset.deduplicate(_t(spark, d, "documents"), "text", order="doc_id").select("doc_id", T.fingerprint(F.col("text")).alias("fp"))


def _samples(spark, d) -> DataFrame:
    none = F.lit(None).cast("string")
    return _t(spark, d, "documents").select(F.col("doc_id").alias("pos"), "text", none.alias("instruction"), none.alias("response"), F.lit("unknown").alias("document_type"), F.col("lang").alias("jurisdiction"), "source", F.create_map().cast("map<string,string>").alias("metadata"))


@query("SELECT count(*) AS num_samples, 0::BIGINT AS num_instructions, sum(length(text))::BIGINT AS total_chars, min(length(text)) AS min_chars, max(length(text)) AS max_chars, sum(length(text)) / count(*) AS avg_chars, (sum(length(text)) // 4)::BIGINT AS estimated_tokens FROM documents")
def corpus_statistics(spark, d):
    return dataset.statistics(_samples(spark, d)).drop("document_types", "jurisdictions")


@query("SELECT coalesce(lang, 'unknown') AS jurisdiction, count(*) AS rows FROM documents GROUP BY 1")
def statistics_by_jurisdiction(spark, d):
    return dataset.statistics(_samples(spark, d)).select(F.explode("jurisdictions").alias("jurisdiction", "rows"))


@query(
    """WITH RECURSIVE u AS (SELECT source, count(*)::DOUBLE AS n, row_number() OVER (ORDER BY min(doc_id), source) AS k FROM documents GROUP BY source), t AS (SELECT sum(n) AS total FROM u),
    r(k, source, split, a, b, c) AS (
      SELECT 0::BIGINT, NULL::VARCHAR, NULL::VARCHAR, 0.8 * total, 0.1 * total, 0.1 * total FROM t
      UNION ALL
      SELECT u.k, u.source, s, a - n * (s = 'train')::INT, b - n * (s = 'validation')::INT, c - n * (s = 'test')::INT
      FROM (SELECT *, CASE WHEN a >= b AND a >= c THEN 'train' WHEN b >= c THEN 'validation' ELSE 'test' END AS s FROM r) x JOIN u ON u.k = x.k + 1
    ) SELECT split, sum(n)::BIGINT AS n_rows FROM r JOIN u USING (source) GROUP BY split"""
)
def group_split(spark, d):
    out = dataset.split(_t(spark, d, "documents"), shuffle=False, group=F.col("source"), order="doc_id")
    return out.groupBy("split").agg(F.count("*").alias("n_rows"))


@query("SELECT doc_id, 'case' AS document_type FROM documents")
def types_by_folder(spark, d):
    path = F.concat(F.lit("corpus/Judgments/"), F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return _t(spark, d, "documents").select("doc_id", corpus.type_of_path(path).alias("document_type"))


@query("SELECT conv_id, turn, text AS instruction, role AS response, conv_id || '#' || turn AS text, '\"' || role || '\"' AS extra FROM conversations")
def sample_mapping(spark, d):
    rows = _t(spark, d, "conversations").select(
        F.struct("conv_id", "turn").alias("pos"), F.to_json(F.struct(F.col("text").alias("question"), F.col("role").alias("answer"), F.concat_ws("#", "conv_id", "turn").alias("input"), F.col("role").alias("extra"))).alias("record")
    )
    return corpus.from_records(rows).select("pos.conv_id", "pos.turn", "instruction", "response", "text", F.element_at("metadata", "extra").alias("extra"))


@query("SELECT conv_id, turn, '<|im_start|>user' || chr(10) || text || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) || role || '<|im_end|>' AS text FROM conversations")
def chat_format(spark, d):
    return _t(spark, d, "conversations").select("conv_id", "turn", prompts.instruction_format(F.col("text"), F.col("role"), template="chatml").alias("text"))


@query("SELECT conv_id, turn, 'Q: ' || text || ' A: ' || role AS text FROM conversations")
def custom_format(spark, d):
    return _t(spark, d, "conversations").select("conv_id", "turn", prompts.instruction_format(F.col("text"), F.col("role"), template="Q: {instruction} A: {response}").alias("text"))


@query("SELECT conv_id, turn, length(text) // 4 AS tokens, left(text, 200) AS preview FROM conversations")
def token_estimates(spark, d):
    return _t(spark, d, "conversations").select("conv_id", "turn", T.estimated_tokens(F.col("text")).alias("tokens"), T.preview(F.col("text")).alias("preview"))


_TURNS = "(SELECT a.conv_id, a.turn, a.text AS a, b.text AS b FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)"
_WORDS = r"regexp_extract_all(lower({0}), '[\pL\pM\pN_]+')"


def _turns(spark, d) -> DataFrame:
    c = _t(spark, d, "conversations")
    return c.alias("x").join(c.alias("y"), (F.col("x.conv_id") == F.col("y.conv_id")) & (F.col("y.turn") == F.col("x.turn") + 1)).select("x.conv_id", "x.turn", F.col("x.text").alias("a"), F.col("y.text").alias("b"))


@query(f"SELECT conv_id, turn, CASE WHEN len(x) = 0 OR len(y) = 0 THEN (len(x) = len(y))::INT::DOUBLE WHEN n = 0 THEN 0.0 ELSE 2 * (n / len(x)) * (n / len(y)) / (n / len(x) + n / len(y)) END AS f1 FROM (SELECT *, coalesce(list_sum(list_transform(list_distinct(x), lambda w: least(len(list_filter(x, lambda v: v = w)), len(list_filter(y, lambda v: v = w))))), 0)::DOUBLE AS n FROM (SELECT conv_id, turn, {_WORDS.format('a')} AS x, {_WORDS.format('b')} AS y FROM {_TURNS}))")
def token_f1(spark, d):
    return _turns(spark, d).select("conv_id", "turn", metrics.token_f1(F.col("a"), F.col("b")).alias("f1"))


@query(f"SELECT conv_id, turn, len(list_intersect(list_distinct(x), list_distinct(y))) / len(list_distinct(x)) AS word_precision, length(a) / greatest(length(b), 1) AS length_ratio FROM (SELECT *, {_WORDS.format('a')} AS x, {_WORDS.format('b')} AS y FROM {_TURNS}) WHERE len(x) > 0")
def answer_similarity(spark, d):
    rows = _turns(spark, d).withColumn("s", metrics.similarity(F.col("a"), F.col("b"))).filter(F.size(T.tokens(F.col("a"))) > 0)
    return rows.select("conv_id", "turn", "s.word_precision", "s.length_ratio")


@query("SELECT conv_id, turn, len(list_filter(regexp_split_to_array(text, '[\\s\\x0B]+'), lambda w: w <> ''))::INT AS word_count, len(list_filter(regexp_split_to_array(text, '[!.?]+'), lambda s: regexp_matches(s, '[^\\s\\x0B]')))::INT AS sentence_count FROM conversations")
def answer_quality(spark, d):
    return _t(spark, d, "conversations").withColumn("q", metrics.quality(F.col("text"))).select("conv_id", "turn", "q.word_count", "q.sentence_count")


@query(f"SELECT o_orderkey, (2 + (n % 2 = 0)::INT)::INT AS legal_term_count, CASE WHEN n % 2 = 0 THEN 'breach,duty of care,tort' ELSE 'breach,duty of care' END AS terms_used FROM {_BASE}")
def terminology(spark, d):
    rows = _built(spark, d, "concat('A breach of the Duty of Care', IF(n % 2 = 0, ' is a tort', ''), ' ', CAST(p AS STRING))").withColumn("t", metrics.terminology(F.col("text")))
    return rows.select("o_orderkey", "t.legal_term_count", F.array_join("t.terms_used", ",").alias("terms_used"))


@query(f"SELECT o_orderkey, CASE WHEN n % 3 = 0 THEN 0.5 ELSE 1.0 END::DOUBLE AS precision, 1.0::DOUBLE AS recall, CASE WHEN n % 3 = 0 THEN 2 / 3 ELSE 1.0 END::DOUBLE AS f1 FROM {_BASE}")
def citation_scores(spark, d):
    rows = _built(spark, d, f"concat({_OPINION}, IF(n % 3 = 0, ' Also [1999] UKHL 7.', ''))")
    wanted = metrics.canonical(F.array(F.expr("concat('[', CAST(y AS STRING), '] uksc ', CAST(n AS STRING))")))
    return rows.withColumn("s", metrics.citation_scores(metrics.normal_citations(F.col("text")), wanted)).select("o_orderkey", "s.precision", "s.recall", "s.f1")


@query(f"SELECT o_orderkey, CASE WHEN n % 4 = 0 THEN 0.5 ELSE 1.0 END::DOUBLE AS grounding_rate FROM {_BASE}")
def grounding(spark, d):
    rows = _built(spark, d, f"concat({_OPINION}, IF(n % 4 = 0, ' Also [1999] UKHL 7.', ''))").withColumn("source", F.expr(_OPINION))
    return rows.select("o_orderkey", metrics.grounding(metrics.normal_citations(F.col("text")), F.col("source"))["grounding_rate"].alias("grounding_rate"))


@query(f"SELECT avg((n % 2 = 0)::INT) AS exact_accuracy, 1.0::DOUBLE AS partial_accuracy, count(*) AS samples FROM {_BASE}")
def contract_qa(spark, d):
    rows = _built(spark, d, "'x'").select(F.expr("IF(n % 2 = 0, 'The term is thirty days long.', 'Thirty, or so, days.')").alias("response"), F.array(F.lit("thirty days")).alias("answers"), F.lit("How long?").alias("question"))
    return benchmark.contract_qa(rows)[1].drop("token_f1")


@query(f"SELECT avg((n % 5 <> 0)::INT) AS accuracy, count(*) AS samples FROM {_BASE}")
def clause_classification(spark, d):
    rows = _built(spark, d, "'x'").select(F.expr("IF(n % 5 = 0, 'A termination clause, not governing law.', 'This is the governing law clause, not termination.')").alias("response"), F.array(F.lit("termination"), F.lit("governing law"), F.lit("governing")).alias("options"), F.lit("Governing law").alias("label"), F.lit("t").alias("text"))
    return benchmark.clause_classification(rows)[1]


@query(f"SELECT sum(h)::DOUBLE / sum(m) AS precision, sum(h)::DOUBLE / count(*) AS recall, 2 * sum(h)::DOUBLE / (sum(m) + count(*)) AS f1, count(*) AS samples FROM (SELECT (n % 2 = 0)::INT AS h, 1 AS m FROM {_BASE})")
def ner_micro(spark, d):
    rows = _built(spark, d, "'x'").select(F.expr("IF(n % 2 = 0, '- Court: the High Court.\\nDate: 3 May', '1. court: Crown Court')").alias("response"), F.array(F.struct(F.lit("court").alias("label"), F.lit("The  High Court").alias("text"))).alias("entities"), F.lit("t").alias("text"))
    return benchmark.legal_ner(rows)[1]


@query(f"SELECT metric, avg(value) AS value FROM (SELECT 'accuracy' AS metric, avg((n % 5 <> 0)::INT)::DOUBLE AS value FROM {_BASE} UNION ALL SELECT 'exact_accuracy', avg((n % 2 = 0)::INT)::DOUBLE FROM {_BASE} UNION ALL SELECT 'partial_accuracy', 1.0) GROUP BY metric")
def suite_summary(spark, d):
    return benchmark.suite_summary(benchmark.task_metrics({"contract_qa": contract_qa(spark, d), "clause_classification": clause_classification(spark, d)}))


@query(f"SELECT o_orderkey, '[EMAIL_' || left(sha256('pepper|email|user' || n || '@example.org'), 8) || '] wrote.' AS text FROM {_BASE}")
def emails_salted(spark, d):
    rows = _built(spark, d, "concat('user', CAST(n AS STRING), '@example.org wrote.')")
    return rows.select("o_orderkey", pii.anonymised(F.col("text"), salt="pepper")["text"].alias("text"))


@query(f"SELECT o_orderkey, 'From [EMAIL_1] to [EMAIL_2], again [EMAIL_1], on [DATE_1].' AS text, 4 AS n_entities FROM {_BASE}")
def entities_numbered(spark, d):
    rows = _built(spark, d, "concat('From a', CAST(n AS STRING), '@x.org to b@x.org, again A', CAST(n AS STRING), '@x.org, on 3 May ', CAST(y AS STRING), '.')")
    return rows.withColumn("r", pii.anonymised(F.col("text"))).select("o_orderkey", "r.text", F.size("r.entities").alias("n_entities"))


@query(f"SELECT o_orderkey, 'Mr Ann Lee' || CASE WHEN n % 2 = 0 THEN ' KC' ELSE '' END || ' wrote to user' || n || '@x.org.' AS text FROM {_BASE}")
def deanonymised(spark, d):
    rows = _built(spark, d, "concat('Mr Ann Lee', IF(n % 2 = 0, ' KC', ''), ' wrote to user', CAST(n AS STRING), '@x.org.')").withColumn("r", pii.anonymised(F.col("text")))
    return rows.select("o_orderkey", pii.restored(F.col("r.text"), F.col("r.mapping")).alias("text"))


@query(f"SELECT entity_type, count(*) AS n FROM (SELECT unnest(['person', 'organisation', 'money']) AS entity_type FROM {_BASE}) GROUP BY 1")
def entity_report(spark, d):
    rows = _built(spark, d, "concat('Mrs Jane Doe of Gamma Trading Ltd paid £', CAST(n AS STRING), ' to the court.')")
    return rows.select(F.explode(pii.anonymised(F.col("text"))["entities"]).alias("e")).groupBy("e.entity_type").agg(F.count("*").alias("n"))


@query(f"SELECT o_orderkey, 3::INT AS n_chunks, '1. Definitions' AS first_section FROM {_BASE}")
def chunk_counts(spark, d):
    body = "concat('1. Definitions\\n', repeat(concat('Word ', CAST(n AS STRING), ' means a thing. '), 8), '\\n2. Payment\\n', repeat('The fee is due. ', 10), '\\n3. Term\\n', repeat('It ends in May. ', 10))"
    rows = _built(spark, d, body).withColumn("c", chunks.chunks_of(F.col("text"), size=60, overlap=0, least=0))
    return rows.select("o_orderkey", F.size("c").alias("n_chunks"), F.col("c")[0]["section"].alias("first_section"))


@query("SELECT doc_id, true AS covered, true AS sliced FROM documents WHERE regexp_matches(text, '\\S')")
def document_chunks(spark, d):
    rows = _t(spark, d, "documents").withColumn("c", chunks.chunks_of(F.col("text"), overlap=0)).filter(F.size("c") > 0)
    plain = lambda c: F.regexp_replace(c, T.BLANK, "")
    same = F.forall("c", lambda x: F.substr("text", x["start_char"] + 1, x["end_char"] - x["start_char"]) == x["text"])
    return rows.select("doc_id", (plain(F.array_join(F.transform("c", lambda x: x["text"]), "")) == plain(F.col("text"))).alias("covered"), same.alias("sliced"))


@query("SELECT * FROM (VALUES ('EWCA Civ', 2), ('uksc', 0), ('The High Court of Justice', 3), ('Moot', 8)) t(court, level)")
def court_levels(spark, d):
    rows = spark.createDataFrame([("EWCA Civ",), ("uksc",), ("The High Court of Justice",), ("Moot",)], "court string")
    return rows.select("court", jurisdiction("uk").court_level(F.col("court")).alias("level"))


@query("SELECT * FROM (VALUES ('9th Cir.', 1), ('S.D.N.Y.', 3), ('S.D. Cal.', 3), ('Bankr. D. Del.', 4), ('SCOTUS', 0)) t(court, level)")
def us_court_levels(spark, d):
    rows = spark.createDataFrame([("9th Cir.",), ("S.D.N.Y.",), ("S.D. Cal.",), ("Bankr. D. Del.",), ("SCOTUS",)], "court string")
    return rows.select("court", jurisdiction("us").court_level(F.col("court")).alias("level"))


@query("SELECT * FROM (VALUES ('Llama-3.1-8B', 8000000000, 8e9 * 0.5 / 1073741824 + 2 + 0.125), ('Mixtral-8x7B', 56000000000, 56e9 * 0.5 / 1073741824 + 2 + 0.125), ('gpt2', 0, 0.0)) t(model, parameters, total_gb)")
def memory_estimates(spark, d):
    rows = spark.createDataFrame([("Llama-3.1-8B",), ("Mixtral-8x7B",), ("gpt2",)], "model string")
    return rows.select("model", F.coalesce(training.parameters(F.col("model")), F.lit(0)).cast("long").alias("parameters"), F.coalesce(training.memory(F.col("model"))["total_gb"], F.lit(0.0)).alias("total_gb"))


@query(f"SELECT o_orderkey, 2 AS n FROM {_BASE}")
def titled_persons(spark, d):
    rows = _built(spark, d, "concat('Mr John Smith\\nClaimant ', CAST(n AS STRING), ' and MRS JANE DOE met Mr Justice Fraser.')")
    return rows.select("o_orderkey", F.size(F.filter(pii.anonymised(F.col("text"))["entities"], lambda e: e["entity_type"] == "person")).alias("n"))
