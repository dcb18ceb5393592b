"""The queries over the votes' join where it is dealt by the pairs that meet: no task holds a quarter of the votes, and the rows are those of the SQL (of Spark's own dealing, where there is no SQL)."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from ionolake.operators import correction

SF = "/root/testdata/sf0.01"
NAMES = ["pipeline_counts", "spot_pipeline", "feed_decisions", "anchored_decisions", "d1_against_d3", "d3_scenarios", "daily_summary", "decision_reasons", "frequent_pairs", "headroom", "m1c_by_distance"]


def rows(df, cols):
    return sorted(map(str, ([r[k] for k in cols] for r in df.collect())))


@pytest.mark.parametrize("name", NAMES)
def test_no_task_holds_most_votes(spark, monkeypatch, name):
    query, sql = entry.queries()[name], entry.oracle_sql().get(name)
    seen, tallies = [], correction.tallies
    monkeypatch.setattr(correction, "tallies", lambda v: seen.append(v) or tallies(v))
    monkeypatch.setattr(correction, "PAIRS", 1 << 14, raising=False)
    out = query(spark, SF)
    cols = sorted(out.columns)
    got = rows(out, cols)
    held = [r["count"] for r in seen[0].select(F.spark_partition_id().alias("task")).groupBy("task").count().collect()]
    assert got and max(held) * 4 <= sum(held)
    if sql:
        import duckdb

        c = duckdb.connect()
        c.execute(f"create view events as select * from read_parquet('{SF}/events.parquet')")
        assert got == sorted(map(str, map(list, c.sql(f"select {', '.join(cols)} from ({sql})").fetchall())))
    else:
        monkeypatch.setattr(correction, "PAIRS", 1 << 40)
        assert got == rows(query(spark, SF), cols)


def test_voters_are_copied_in_many_tasks(spark, monkeypatch):
    seen, sides = [], correction._sides
    monkeypatch.setattr(correction, "_sides", lambda *a: seen.append(sides(*a)) or seen[-1])
    monkeypatch.setattr(correction, "PAIRS", 1 << 14)
    entry.queries()["feed_decisions"](spark, SF)
    assert seen[0][1].rdd.getNumPartitions() > correction.FEW >= spark.read.parquet(f"{SF}/events.parquet").rdd.getNumPartitions()
