import duckdb
import pytest

import corpus_pipeline
from dossier.llm import queries

TABLES = "documents embeddings pages benchmark labels conversations".split()


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, sf_dir, name):
    rows = queries.QUERIES[name](spark, sf_dir)
    got = rows.collect()
    assert got
    if name not in queries.ORACLES:
        return
    second = duckdb.connect()
    for table in TABLES:
        second.execute(f"create view {table} as select * from '{sf_dir}/{table}.parquet'")
    found = second.execute(queries.ORACLES[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(rows.columns)
    want = found.fetchall()
    assert sorted(map(str, want)) == sorted(str(tuple(r[c] for c in columns)) for r in got)


def test_there_is_one_query_of_each_operator():
    numbers = [int(n[2:].split("_")[0]) for n in queries.QUERIES]
    assert sorted(numbers) == list(range(1, 14))


def test_pipeline_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    frame = docs
    for at, (_, stage) in enumerate(corpus_pipeline.STAGES):
        after = stage(spark, frame, sf_dir)
        if at < 3:
            assert after.schema.names == docs.schema.names
            assert [f.dataType for f in after.schema] == [f.dataType for f in docs.schema]
            rows = after.collect()
            assert rows and all(r.n_chars == len(r.text) for r in rows)
            frame = spark.createDataFrame(rows, docs.schema)
    packed = after.collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in frame.collect()}
    assert sorted(map(str, corpus_pipeline.run(spark, sf_dir).select("doc_id", "start", "n_tokens").collect())) == sorted(
        str(r) for r in after.select("doc_id", "start", "n_tokens").collect()
    )
