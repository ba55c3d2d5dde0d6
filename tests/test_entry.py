"""The driver contract: entry() runs the flagship on sf0.001 with a stable schema."""

import __spark_entry__ as e


def test_entry_flagship(spark, smoke_dir):
    df = e.entry(spark)
    assert df.columns == ["userId", "movieId", "title", "genres", "score"]
    n = df.count()
    assert n > 0
    per_user = df.groupBy("userId").count().agg({"count": "max"}).first()[0]
    assert per_user <= 20
    assert e.entry(spark).schema == df.schema


def test_every_query_builds(spark, smoke_dir):
    for name, q in e.queries().items():
        df = q(spark, smoke_dir)
        assert len(df.columns) == len(set(df.columns)), name
