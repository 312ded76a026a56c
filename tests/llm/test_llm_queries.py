"""Every registered query by its name: those with SQL against DuckDB, the
others for a row of each document."""

import os

import duckdb
import pytest

from sheafwork.llm import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def frame_of(name, spark, folder):
    return queries.QUERIES[name](spark, folder)


def compared(name, spark, folder):
    con = duckdb.connect()
    for table in ("documents", "embeddings"):
        if os.path.exists(f"{folder}/{table}.parquet"):
            at = f"{folder}/{table}.parquet"
            con.execute(f"create view {table} as select * from '{at + '/*.parquet' if os.path.isdir(at) else at}'")
    frame = frame_of(name, spark, folder)
    columns = sorted(frame.columns)
    want = con.execute(queries.ORACLES[name])
    found = [d[0] for d in want.description]
    assert sorted(found) == columns
    places = [found.index(c) for c in columns]
    assert sorted((tuple(r) for r in frame.select(*columns).collect()), key=repr) == sorted((tuple(r[p] for p in places) for r in want.fetchall()), key=repr)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, name):
    compared(name, spark, SF)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_query_has_every_document(spark, name):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = frame_of(name, spark, SF)
    if name == "op10_mixing":
        assert 0 < rows.count() and rows.join(docs, "doc_id", "left_anti").isEmpty()
        return
    ids = rows.select("doc_id").distinct()
    assert ids.count() == docs.count() and docs.join(ids, "doc_id", "left_anti").isEmpty()
    if name != "op4_packing":
        assert rows.count() == docs.count()


def test_rules_of_unlisted_languages_equal_their_sql(spark, tmp_path):
    import random

    draw = random.Random(3)
    words = "и в не на что он как это по но дом река окно утро письмо сад тихо камень улица вода".split()
    rows = [(k, " ".join(draw.choice(words) + draw.choice(["", "а", "ом"]) for _ in range(90 + k)), "ru") for k in range(12)]
    rows += [(20, rows[0][1], None), (21, rows[1][1], "xx"), (22, "# $ % " * 50, "ru"), (23, "one two", "yy"), (24, None, "ru"), (25, "the of and " * 40 + "a b c", "en")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    compared("op6_quality_rules", spark, str(tmp_path))
