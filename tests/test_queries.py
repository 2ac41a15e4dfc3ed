"""Every registered query against its SQL in DuckDB, at the smallest scale."""

import random
from decimal import Decimal

import duckdb
import pytest

from portcullis import plans
from portcullis.sources.tables import TABLES

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    connection.execute("SET timezone = 'UTC'")
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SF_DIR}/{name}.parquet')")
    return connection


def plain(row):
    return tuple(repr(round(float(x), 6)) if isinstance(x, (float, Decimal)) else repr(x) for x in row)


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, duck, name):
    found = plans.QUERIES[name](spark, SF_DIR)
    columns = sorted(found.columns)
    rows = sorted(plain(r) for r in found.select(*columns).collect())
    if name in plans.ORACLE_SQL:
        result = duck.execute(plans.ORACLE_SQL[name])
        names = [d[0] for d in result.description]
        assert sorted(names) == columns
        order = [names.index(c) for c in columns]
        assert rows == sorted(plain([r[i] for i in order]) for r in result.fetchall())


def test_masked_card_numbers_with_blanks(spark, tmp_path):
    r = random.Random(5)
    texts = ["42 4366089147969128 ly", "see 4111 1111 1111 1111, 4111-1111-1111-1111 or 4111 111111111111\t5 500 0000 0000 0004", "4111111111111111 4222222222222 10.0.0.1 10.0.0.2 a@b.example.org", None, ""]
    for _ in range(3000):  # runs of digits that blanks, dashes and dots cut anywhere
        texts.append("".join(r.choice(r.choice(["3456", "0123456789", "0123456789", "0123456789"] + [" -.\nx"] * r.randint(0, 1))) for _ in range(r.randint(14, 60))))
    rows = [(i, text, "en") for i, text in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    found = plans.QUERIES["pii_masked_values"](spark, str(tmp_path)).select("doc_id", "kind", "masked", "n").collect()
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert sorted(map(tuple, found)) == sorted(connection.execute(plans.ORACLE_SQL["pii_masked_values"]).fetchall())
    assert sum(r.kind == "credit_card" and r.doc_id > 4 for r in found) > 100


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(plans.ORACLE_SQL) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
