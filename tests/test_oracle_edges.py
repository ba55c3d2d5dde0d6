"""Spark queries and their SQL oracle agree on edge-case inputs too.

A tiny set of driver-shaped tables (same column names and types) is
written for this test only: null names, brands, sizes and keys, a negative
key, quotes, very long and non-ASCII names, and order timestamps with
fractional seconds.  Every query that does not need a model must still
equal its oracle on it.
"""

import datetime as dt
import os

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from reelspark.plans.oracle import ORACLE_SQL


def _part_rows():
    rows = [
        (0, "plain red", "Brand#1", "TYPE A", 3, 10.0),
        (1, None, "Brand#2", "TYPE B", 4, 11.0),
        (2, "it's (x) red", None, "TYPE C", 5, 12.0),
        (-3, "negative red", "Brand#1", "TYPE A", 6, 13.0),
        (13, "red thing", "Brand#13", "TYPE B", None, 14.0),
        (None, "no key red", "Brand#3", "TYPE C", 7, 15.0),
        (17, "red " * 25, "Brand#1", "TYPE A", 8, 16.0),
        (24, "ünïcødé red 😀", "Brand#1", "TYPE Ä", 9, 17.0),
    ]
    rows += [(k, f"red item {k}", f"Brand#{k % 4}", f"TYPE {'ABC'[k % 3]}", k % 11, float(k)) for k in range(30, 75)]
    return rows


def _write(dir_, name, cols, schema):
    pq.write_table(pa.table(cols, schema=schema), os.path.join(dir_, f"{name}.parquet"))


@pytest.fixture(scope="module")
def edge_dir(tmp_path_factory):
    d = str(tmp_path_factory.mktemp("edge-tables"))
    part = _part_rows()
    _write(d, "part", {
        "p_partkey": [r[0] for r in part], "p_name": [r[1] for r in part], "p_brand": [r[2] for r in part],
        "p_type": [r[3] for r in part], "p_size": [r[4] for r in part], "p_retailprice": [r[5] for r in part],
    }, pa.schema([("p_partkey", pa.int64()), ("p_name", pa.string()), ("p_brand", pa.string()),
                  ("p_type", pa.string()), ("p_size", pa.int32()), ("p_retailprice", pa.float64())]))
    base = dt.datetime(1995, 1, 1)
    orders = [(k, 100 + k % 7 if k % 13 else None, base + dt.timedelta(days=k * 3, seconds=k * 37, microseconds=(k * 170_000) % 1_000_000))
              for k in range(1, 60)]
    _write(d, "orders", {"o_orderkey": [o[0] for o in orders], "o_custkey": [o[1] for o in orders],
                         "o_orderdate": [o[2] for o in orders]},
           pa.schema([("o_orderkey", pa.int64()), ("o_custkey", pa.int64()), ("o_orderdate", pa.timestamp("us"))]))
    keys = [r[0] for r in part if r[0] is not None]
    items = []
    for o in range(1, 60):
        for j in range(6):
            items.append((o, keys[(o * 7 + j * 5) % len(keys)], float((o * j) % 50 + 1)))
    items.append((5, None, 3.0))
    _write(d, "lineitem", {"l_orderkey": [i[0] for i in items], "l_partkey": [i[1] for i in items],
                           "l_quantity": [i[2] for i in items]},
           pa.schema([("l_orderkey", pa.int64()), ("l_partkey", pa.int64()), ("l_quantity", pa.float64())]))
    return d


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_edge_tables_match_oracle(spark, edge_dir, name):
    from tools.check_oracle import compare

    res = compare(spark, edge_dir, [name], verbose=False)[name]
    assert res.startswith("ok"), res
