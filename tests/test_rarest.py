"""Subscribers by their rarest rule: the same deliveries, fewer meetings."""

import random

from pyspark.sql import functions as F

from ionolake import queries as base
from ionolake.functions import radio
from ionolake.operators import filters
from ionolake.plans.spots import spots


def random_filters(n):
    rng, out = random.Random(17), []
    calls = [f"K{i}{t}" for i in range(10) for t in ("ABC", "AB8", "A88", "Z88", "QRST")]
    for i in range(n):
        lines = []
        for _ in range(rng.randint(0, 3)):
            lines.append(rng.choice([
                lambda: f"PASS DXCALL {rng.choice(calls)}", lambda: f"PASS DXCALL {rng.choice(calls)[:3]}*", lambda: f"PASS DXZONE {rng.randint(1, 40)} {rng.randint(1, 40)}", lambda: f"PASS MODE {rng.choice(['CW', 'RTTY', 'FT8'])}",
                lambda: f"REJECT DXCONT {rng.choice(radio.CONTINENTS)}", lambda: "PASS BAND 20M", lambda: f"PASS DXDXCC {rng.randint(1, 24)}", lambda: "REJECT MODE FT4", lambda: "PASS CONFIDENCE V", lambda: "REJECT BEACON", lambda: "REJECT DXCALL ALL" if rng.random() < 0.1 else "PASS DXGRID2 FN",
            ])())
        out.append((rng.choice(calls) if i % 9 == 0 else f"S{i}", base._filter(*lines)))
    # a subscriber of a spot's call has that as its name
    return list({name: (name, f) for name, f in out}.values())


def test_the_same_deliveries_with_fewer_meetings(spark, sf):
    s = base._wide(spots(spark, sf)).cache()
    table = filters.filter_table(spark, random_filters(400))
    pairs = lambda d: {(r["subscriber"], r["event_id"]) for r in d.select("subscriber", "event_id").collect()}
    rare = filters.deliver_by_rarest(s, table)
    assert pairs(rare) == pairs(filters.deliver_by_table(s, table)) and rare.columns == [*s.columns, "subscriber"]
    assert rare.count() == rare.distinct().count()
    counts = filters.shares(s)
    index = filters.rarest_rules(table, counts)
    # filters with a list, which all stood under every band before; one without any meets every spot, as it lets most through
    listed = index.where("dim <> ''")
    met = listed.join(counts, ["dim", "value"]).agg(F.sum("n")).first()[0]
    assert met < listed.select("subscriber").distinct().count() * s.count() / 2


def test_many_filters_of_random_rules(spark, sf):
    """A hundred thousand filters, by a join of plain rows: as many as name a call meet its spots only."""
    s = base._wide(spots(spark, sf))
    rules = ", ".join(f"named_struct('allow', cast(array() as array<string>), 'block', cast(array() as array<string>), 'every', true, 'none', false) as {d.lower()}" for d in filters.DIMENSIONS if d != "DXCALL")
    table = spark.sql(f"select concat('S', id) as subscriber, concat('S', id) as call, true as beacons, named_struct('allow', array(concat('K', id % 5000, 'ABC')), 'block', cast(array() as array<string>), 'every', false, 'none', false) as dxcall, {rules} from range(100000)")
    table = table.select("subscriber", "call", "beacons", *[d.lower() for d in filters.DIMENSIONS])
    got = filters.deliver_by_rarest(s, table).groupBy("dx_call").agg(F.count("*").alias("n"))
    want = s.where(F.col("dx_call").rlike("^K[0-9]ABC$")).groupBy("dx_call").agg((F.count("*") * 20).alias("n"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() == 10
