"""The corpus pipeline stage by stage."""

import os

import pytest

import corpus_pipeline
from terrane.llm.common import table
from terrane.llm.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


def test_stages_keep_columns_and_shrink(spark, tmp_path):
    docs = table(spark, DATA, "documents")
    columns, n = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        path = f"file://{tmp_path}/{name}"
        stage(spark, docs, DATA).write.parquet(path)
        docs = spark.read.parquet(path)
        assert docs.columns == columns
        assert 0 < docs.count() <= n * 1.3
    last = corpus_pipeline.STAGES[-1][1](spark, docs, DATA)
    assert last.count() == docs.count() and last.where("not same").count() == 0
    assert corpus_pipeline.run(spark, DATA).count() == docs.count()


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        con.execute(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    df = QUERIES[name](spark, DATA)
    out = con.sql(ORACLE_SQL[name])
    place = {c: i for i, c in enumerate(out.columns)}
    assert sorted(place) == sorted(df.columns)
    assert sorted(str([r[c] for c in sorted(place)]) for r in df.collect()) == sorted(str([r[place[c]] for c in sorted(place)]) for r in out.fetchall())
