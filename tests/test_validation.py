"""Envelopes of odd rows: the query counts the errors that its SQL counts, the rules tell all."""

import duckdb
import pytest
from pyspark.sql import functions as F

from corpusloom import catalog
from corpusloom.operators import validate
from corpusloom.plans import contents

ROWS = [(0, "a"), (1, None), (2, ""), (3, " \t\n"), (4, "b"), (5, "  "), (6, "c"), (12, None), (-4, ""), (-3, "d"), (None, "e"), (None, None)]


@pytest.fixture
def documents(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string")


def test_same_rows(documents, tmp_path):
    documents.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    df = catalog.queries()["envelope_validation"](documents.sparkSession, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    key = lambda rows: sorted(map(tuple, rows), key=str)
    assert key(df.collect()) == key(con.sql(catalog.oracle_sql()["envelope_validation"]).select(*df.columns).fetchall())


def test_rules_tell_blank_texts(documents):
    e = contents.envelopes(documents, F.col("doc_id"), "text", text=F.col("text"))
    got = {(r.id, r.text): r.errors for r in e.select("id", "payload.text", validate.envelope_errors().alias("errors")).collect()}
    assert got[("1", None)] == got[("3", " \t\n")] == ["payload"] and got[("0", "a")] == [] and got[(None, None)] == ["id", "payload"]
