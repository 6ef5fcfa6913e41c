"""Every query of the catalogue against its SQL on a second engine."""

import duckdb
import pytest

import __spark_entry__ as entry
from dossier.plans import catalog
from dossier.plans.oracles import ORACLES

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()
TYPES = {"bigint": "BIGINT", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN", "int": "INTEGER"}


@pytest.fixture(scope="module")
def second(sf_dir):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return connection


def _sorted(rows):
    return sorted(rows, key=lambda r: [(v is not None, str(v)) for v in r])


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, second, sf_dir, name):
    frame = entry.queries()[name](spark, sf_dir)
    columns = sorted(frame.columns)
    got = [tuple(r[c] for c in columns) for r in frame.collect()]
    result = second.execute(entry.oracle_sql()[name])
    described = {d[0]: str(d[1]) for d in result.description}
    order = [list(described).index(c) for c in columns]
    wanted = [tuple(r[i] for i in order) for r in result.fetchall()]
    assert {c: TYPES[t] for c, t in frame.dtypes} == described
    assert got and _sorted(got) == _sorted(wanted)


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(ORACLES)


def test_entry(spark):
    frame = entry.entry(spark)
    assert frame.columns == ["url", "combined"] and frame.count() > 0


def test_no_python_in_plans(spark, sf_dir):
    for name in ("page_text", "page_links", "text_chunks", "request_validate", "report_messages", "query_fanout"):
        plan = entry.queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Pandas" not in plan, name
