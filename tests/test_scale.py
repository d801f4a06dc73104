"""That work on many small rows is shared out and not done twice."""

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lexloom.functions import citations, metrics, names, pii
from lexloom.plans import catalogue, forms

TEXT = "'[' || k || '] UKSC 1; 2 U.S. 3; Article ' || k || ' TFEU'"


@pytest.fixture(scope="module")
def one_group(tmp_path_factory):
    """customer and orders of 60,000 rows each, in one row group."""
    d, n = tmp_path_factory.mktemp("tables"), 60_000
    keys = pa.array(range(n), pa.int64())
    dates = pa.array([i * 86_400_000_000 for i in range(n)], pa.timestamp("us"))
    pq.write_table(pa.table({"c_custkey": keys, "c_nationkey": pa.array([i % 25 for i in range(n)], pa.int32())}), d / "customer.parquet")
    pq.write_table(pa.table({"o_orderkey": keys, "o_custkey": keys, "o_orderdate": dates}), d / "orders.parquet")
    return str(d)


def shares(rows):
    counts = [r["n"] for r in rows.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
    return len(counts), max(counts)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_customers_of_one_row_group_are_dealt_out(spark, one_group):
    tasks, largest = shares(forms.rows_of(spark, one_group, text="a || ' v ' || b"))
    assert tasks >= 8 and largest < 60_000 / 4


def test_orders_of_one_row_group_are_dealt_out(spark, one_group):
    tasks, largest = shares(catalogue._built(spark, one_group, catalogue._OPINION))
    assert tasks >= 8 and largest < 60_000 / 4


def test_a_jurisdiction_reads_only_its_own_texts(spark, one_group, monkeypatch):
    rows = forms.QUERIES["citations_of_jurisdiction"](spark, one_group)
    eval_line = next(line for line in plan(rows).splitlines() if "ArrowEvalPython" in line)
    assert all(f"% 3) = {rest}) THEN" in eval_line for rest in range(3))
    monkeypatch.setitem(citations.READERS, "square", lambda text, a: pytest.fail("read for nothing"))
    assert [c.normalised for c in citations.parse("[2020] UKSC 1; 2 U.S. 3", only=frozenset(["us"]))] == ["2 U.S. 3"]


def test_every_kind_of_anchor_gives_only_what_it_says():
    texts = ["[2020] UKSC 1 [2020] 1 AC 2 [1999] ECR 5", "(1999) 3 App Cas 4 (1999) 29 EHRR 6", "2 U.S. 3 and 42 U.S.C. § 5", "Case C-1/02 ECLI:EU:C:2010:3", "CPR r 3.4", "Directive 95/46/EC", "Article 5 TFEU, art 6 ECHR, art 7 UK GDPR.", "section 5 of the Moss Act 1998"]
    for text in texts:
        every = citations.parse(text, unique=False)
        assert every and [c for tag in citations.TAGS for c in citations.parse(text, False, frozenset([tag]))] == sorted(every, key=lambda c: citations.TAGS.index(c.jurisdiction))


def test_texts_that_are_alike_are_read_once():
    seen = []

    def run(texts):
        seen.extend(texts)
        return pa.array([t.upper() for t in texts])

    assert citations.each_once(pa.array(["a", "b", None, "a", "b"]), run).to_pylist() == ["A", "B", None, "A", "B"]
    assert seen == ["a", "b"]
    assert citations.each_once(pa.array(["c", "d"]), run).to_pylist() == ["C", "D"]


def test_columns_over_repeated_and_missing_texts(spark):
    texts = ["Mr Ian Moss in [2020]  uksc 1", None, "", "plain", "Mr Ian Moss in [2020]  uksc 1", None, "a@x.org A@X.org"]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").coalesce(1)
    got = rows.select("k", citations.citations_of(F.col("t")).alias("c"), citations.with_normal_citations(F.col("t")).alias("n"), pii.training_pairs(F.col("t")).alias("p")).orderBy("k").collect()
    for r, t in zip(got, texts, strict=True):
        if t is None:
            assert (r.c, r.n, r.p) == (None, None, None)
            continue
        own = pii.Anonymiser()
        assert [c.normalised for c in r.c] == [c.normalised for c in citations.parse(t)] and r.n == citations.rewritten(t, citations.parse(t, unique=False))
        assert (r.p.text, r.p.reverse) == own.training_pair(t) and r.p.mapping == own.mapping


def test_pairs_and_their_way_back_take_one_function(spark):
    rows = spark.createDataFrame([("Mr Ian Moss",)], "t string").select(pii.training_pairs(F.col("t")).alias("p")).select("p.text", "p.reverse")
    assert plan(rows).count("ArrowEvalPython") == 1


def test_expected_citations_are_read_once_in_a_batch(spark):
    rows = spark.createDataFrame([(["[2020] uksc 1", "no  case"],), (None,), ([],), (["no  case"],)], "e array<string>").coalesce(1)
    assert [r.c for r in rows.select(metrics.canonical(F.col("e")).alias("c")).collect()] == [["[2020] UKSC 1", "no case"], None, [], ["no case"]]


def test_what_a_word_is_is_worked_out_once():
    names._word_kind.cache_clear()
    for _ in range(50):
        names.persons("Mr John Smith and Mrs Jane Doe met Mr Justice Fraser.")
    assert names._word_kind.cache_info().misses < 20


def test_a_legal_form_after_a_blank_on_the_next_line():
    assert pii.Anonymiser().anonymise("with Moss Trading\n Limited and more")[0] == "with [ORGANISATION_1] and more"


def test_a_long_s_names_a_provision():
    assert [c.normalised for c in citations.parse("by the Moss Act 1998, ſ 5")] == ["Moss Act 1998, s 5"]


def test_a_case_name_is_worked_out_once():
    citations._case_at_end.cache_clear()
    for year in range(2000, 2020):
        assert citations.case_name(f"As held in Alpha v Beta [{year}] UKSC 1", 24) == ("Alpha v Beta", 11, 23)
    assert citations._case_at_end.cache_info().misses == 1
