import __spark_entry__
import pytest
from lexloom.plans import forms

SF = "/root/testdata/sf0.001"


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert not set(__spark_entry__.oracle_sql()) - set(__spark_entry__.queries())


@pytest.mark.parametrize("name", ["neutral_citation_counts", "citation_offsets", "terminology", "titled_persons", "exact_dedup", "group_split", "token_f1", "entities_numbered", *forms.QUERIES])
def test_against_sql(spark, name):
    import os

    import duckdb

    con = duckdb.connect()
    for file in os.listdir(SF):
        con.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{file}'")
    ours = __spark_entry__.queries()[name](spark, SF)
    names = sorted(ours.columns)
    theirs = con.execute(f"SELECT {', '.join(names)} FROM ({__spark_entry__.oracle_sql()[name]})").fetchall()
    rounded = lambda rows: sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in rows)
    assert rounded(map(tuple, ours.select(*names).collect())) == rounded(theirs)
