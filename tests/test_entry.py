import __spark_entry__ as entry


def test_entry_runs(spark):
    rows = entry.entry(spark).collect()
    assert rows and set(rows[0].asDict()) == {"decision", "reason", "distance", "n"}


def test_names_match():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and len(q) > 50


def test_some_queries_against_sql(spark, sf):
    import duckdb

    c = duckdb.connect()
    c.execute(f"create view events as select * from read_parquet('{sf}/events.parquet')")
    q, o = entry.queries(), entry.oracle_sql()
    for name in ("spots_projection", "license_base_call", "fixed_width_line", "secondary_dedup", "consensus_decisions", "harmonics", "freq_average", "subscribers_theta", "stability_bucket", "feed_decisions", "anchored_decisions", "keyed_distances", "primary_dedup_loose", "secondary_dedup_loose", "stream_dedup_loose", "stream_decisions", "reliability_lines", "busted_log", "scalar_functions", "corrections_with_valid_calls", "sql_functions", "skew_json", "grid_merge", "filter_more_dimensions", "activity_states", "fed_back_decisions", "learning_decisions", "stream_late_rows"):
        a = q[name](spark, sf)
        cols = sorted(a.columns)
        want = sorted(map(str, ([r[cols.index(k)] for k in cols] for r in c.sql(f"select {', '.join(cols)} from ({o[name]})").fetchall())))
        assert sorted(map(str, ([r[k] for k in cols] for r in a.collect()))) == want, name


def test_grid_merge_meets_stored_rows(spark, sf, monkeypatch):
    import duckdb

    from ionolake.operators import lookups

    merge, stored = lookups.merge_calls, []
    monkeypatch.setattr(lookups, "merge_calls", lambda old, new: stored.append(old) or merge(old, new))
    a = entry.queries()["grid_merge"](spark, sf)
    assert stored[-1].count() > 0 and stored[-1].where("observations > 1").count() > 0
    c = duckdb.connect()
    c.execute(f"create view events as select * from read_parquet('{sf}/events.parquet')")
    cols = sorted(a.columns)
    want = sorted(map(str, c.sql(f"select {', '.join(cols)} from ({entry.oracle_sql()['grid_merge']})").fetchall()))
    assert sorted(str(tuple(r[k] for k in cols)) for r in a.collect()) == want


def test_filter_blocks_the_unknown_country(spark):
    import duckdb

    sf = "/root/testdata/sf0.01"  # has spots of country 0 that pass all other rules
    c = duckdb.connect()
    c.execute(f"create view events as select * from read_parquet('{sf}/events.parquet')")
    want = sorted(i for (i,) in c.sql(entry.oracle_sql()["filter_more_dimensions"]).fetchall())
    assert sorted(r["event_id"] for r in entry.queries()["filter_more_dimensions"](spark, sf).collect()) == want
