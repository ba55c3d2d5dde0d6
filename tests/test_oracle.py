"""Every deterministic named query against its SQL oracle (DuckDB)."""

import pytest

from reelspark.plans.oracle import ORACLE_SQL
from reelspark.plans.queries import QUERIES


def test_every_query_is_registered_in_entry():
    import __spark_entry__ as e

    assert set(QUERIES) <= set(e.queries())
    # beside them, only those of the optional subpackage
    assert all(n == "pipeline" or n.startswith("op") for n in set(e.queries()) - set(QUERIES))
    assert set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_oracle(spark, smoke_dir, name):
    from tools.check_oracle import compare

    res = compare(spark, smoke_dir, [name], verbose=False)[name]
    assert res.startswith("ok"), res


SPARK_TO_DUCK = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR",
                 "float": "FLOAT", "boolean": "BOOLEAN"}


def test_column_types_match_oracle(spark, smoke_dir):
    from tools.check_oracle import duck_connect

    con = duck_connect(smoke_dir)
    bad = {}
    for name, sql in ORACLE_SQL.items():
        s = {f.name: SPARK_TO_DUCK.get(f.dataType.simpleString(), f.dataType.simpleString())
             for f in QUERIES[name](spark, smoke_dir).schema.fields}
        d = {c[0]: str(c[1]) for c in con.execute(f"DESCRIBE {sql}").fetchall()}
        if s != d:
            bad[name] = (s, d)
    assert not bad, bad
