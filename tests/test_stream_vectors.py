"""Sliding windows over streams against their batch forms, with rows out of order; staging of uneven ranges."""

import random

import pytest
from pyspark.sql import functions as F

from rivulet.operators import timeseries as ts
from rivulet.plans import alert_queries as aq
from rivulet.plans import sqlgen as q
from rivulet.streaming import alert_state, panes, storage, tables
from rivulet.streaming import sources as src

SAMPLES = "series string, lkey string, ts long, sample_id long, value double"
T0 = 1_700_000_000_000
CLOSE = ("-", "-", T0 + 10**9, 0, None)


def _samples(seed, n=160):
    """Two counters with resets, ties, gaps and dense stretches."""
    rng, rows = random.Random(seed), []
    for series in ("a", "b"):
        v, t = 0, T0
        for _ in range(n):
            t += rng.choice([0, 1000, 20_000, 60_000, 61_000, 400_000])
            v = rng.randint(0, 3) if rng.random() < 0.05 else v + rng.randint(0, 9)
            rows.append((series, series, t, len(rows), float(v)))
    return rows


def _stream(spark, rows, schema, order, files=4):
    """Rows as files in the order of ``order``, one per micro-batch."""
    path, rows = storage.fresh_path(spark, "vec"), sorted(rows, key=order)
    n = -(-len(rows) // files)
    for i in range(files):
        spark.createDataFrame(rows[i * n:(i + 1) * n], schema).coalesce(1).write.mode("append").parquet(path + "/data")
    return lambda: src.file_stream(spark, path, schema, 1)


def _put_out(spark, stream, schema):
    out = storage.fresh_path(spark, "vec-out")
    q = tables.run_append(stream, out, storage.fresh_path(spark, "ck"))
    q.awaitTermination()
    return spark.read.schema(schema).parquet(out), q


def _batch(spark, rows):
    return (spark.createDataFrame(rows, SAMPLES).withColumn("metric", F.lit("m"))
            .withColumn("labels", F.create_map(F.lit("s"), F.col("series"))))


def _triples(df):
    return sorted((r.lkey, r.t, round(r.value, 6)) for r in df.where("lkey <> '-'").collect())


@pytest.mark.parametrize("kind", ["rate", "delta", "instant"])
def test_stream_of_unordered_samples_equals_batch(spark, kind):
    rng, rows = random.Random(8), _samples(8)
    late = {id(r): rng.randint(0, 500_000) for r in rows}                       # inside the lateness of ten minutes
    stream = _stream(spark, [*rows, CLOSE], SAMPLES, lambda r: r[2] + late.get(id(r), 0))
    got, q = _put_out(spark, panes.vector_stream(stream(), kind, 300_000, 60_000).select("t", "lkey", "value"),
                      "t long, lkey string, value double")
    b = _batch(spark, rows)
    want = {"rate": lambda: ts.rate(b, 300_000, 60_000), "delta": lambda: ts.delta(b, 300_000, 60_000),
            "instant": lambda: ts.instant(b, 60_000, 300_000)}[kind]()
    assert _triples(got) == _triples(want) and alert_state.dropped_rows(q) == 0
    kept = {o["operatorName"]: o["numRowsTotal"] for o in q.lastProgress["stateOperators"]}
    assert kept["transformWithStateInPandasExec"] == 0                          # nothing is held after the last step


def test_stream_runs_in_a_session_without_a_named_state_store(spark):
    """A caller's session has Spark's default provider, which holds one state per operator; it is left as it was."""
    named = spark.conf.get(tables.STATE_STORE)
    spark.conf.unset(tables.STATE_STORE)
    try:
        rows = _samples(3, 40)
        stream = _stream(spark, [*rows, CLOSE], SAMPLES, lambda r: r[2], files=2)
        got, _ = _put_out(spark, panes.vector_stream(stream(), "delta", 300_000, 60_000).select("t", "lkey", "value"),
                          "t long, lkey string, value double")
        assert _triples(got) == _triples(ts.delta(_batch(spark, rows), 300_000, 60_000))
        assert spark.conf.get(tables.STATE_STORE, None) is None
    finally:
        spark.conf.set(tables.STATE_STORE, named)


def test_ratio_of_two_streams_equals_batch(spark):
    a, b = _samples(1, 80), [(s, k, t + 30_000, i, v * 2) for s, k, t, i, v in _samples(2, 80)]
    left, right = (_stream(spark, [*rows, CLOSE], SAMPLES, lambda r: r[2]) for rows in (a, b))
    ratio = panes.divided(*(panes.vector_stream(s(), "instant", 300_000, 60_000) for s in (left, right)), ts.ieee_divide)
    got, _ = _put_out(spark, ratio, "t long, lkey string, value double")
    want = ts.binary(ts.instant(_batch(spark, a), 60_000, 300_000), ts.instant(_batch(spark, b), 60_000, 300_000), "/")
    key = lambda rows: sorted((r.lkey, r.t, str(round(r.value, 6))) for r in rows.where("lkey <> '-'").collect())
    assert key(got) == key(want) and key(got)


def test_hopping_state_holds_panes_only(spark):
    rng = random.Random(3)
    schema = "event_time timestamp, orderunits double, address struct<state: string>"
    rows = [(T0 // 1000 + rng.randrange(3600), float(rng.randint(1, 9)), (rng.choice(["X", "Y", None]),)) for _ in range(900)]
    done = (T0 // 1000 + 10**7, 0.0, ("-",))
    from datetime import datetime
    made = [(datetime.fromtimestamp(s), u, a) for s, u, a in (*rows, done)]
    stream = _stream(spark, made, schema, lambda r: r[0])()
    got, q = _put_out(spark, panes.hopping_by_state(stream, 300_000, 60_000, "1 minute"),
                      "state string, window_start long, window_end long, order_count long, avg_units double")
    want = {}
    for s, u, (state,) in rows:
        for k in range(5):
            want.setdefault((state, (s // 60 - k) * 60_000), []).append(u)
    assert {(r.state, r.window_start): (r.order_count, round(r.avg_units, 9)) for r in got.collect() if r.state != "-"} == {
        k: (len(v), round(sum(v) / len(v), 9)) for k, v in want.items()}
    panes_at_once = max(o["numRowsTotal"] for p in q.recentProgress for o in p["stateOperators"]
                        if o["operatorName"] == "transformWithStateInPandasExec")
    assert panes_at_once <= 3 * (5 + 4)                          # per state: its last panes, a step and timers


# --- staging ------------------------------------------------------------------------------------

def _active_rows(hours):
    return [("A", f"g{g}", T0 // 3_600_000 * 3_600_000 + h * 3_600_000, 1.0, 7_200_000) for h in hours for g in range(60)]


@pytest.mark.parametrize("rows_per_file", [2_000_000, 800])
def test_an_empty_range_loses_no_rows(spark, rows_per_file):
    rows = _active_rows([*range(100), *range(300, 400)])
    df = spark.createDataFrame(rows, "alert string, lkey string, t long, value double, for_ms long")
    path, files = src.stage_topic(spark, "gap", (storage.fresh_path(spark, "k"),), lambda: df, "t", 4, rows_per_file)
    assert storage.count_files(spark, path + "/data", ".parquet") == 4 * files
    stream = src.file_stream(spark, path, df.schema, files)
    got, q = _put_out(spark, alert_state.hold_stream(stream, 3_600_000), alert_state.OUTPUT_SCHEMA)
    last = max(r[2] for r in rows)                                # steps the watermark hasn't passed wait in the state
    assert got.where("state <> 'resolved'").count() == len([r for r in rows if r[2] <= last]) == 12_000
    assert alert_state.dropped_rows(q) == 0


def test_a_small_range_leaves_hot_ranges_their_files(spark):
    df = spark.range(6020).select("id", F.least(F.floor(F.col("id") / 2000), F.lit(3)).alias("p"))
    path, files = src.stage_topic(spark, "uneven", (storage.fresh_path(spark, "k"),), lambda: df, "p", 4, rows_per_file=200)
    assert files == 10 and storage.count_files(spark, path + "/data", ".parquet") == 40
    assert spark.read.parquet(path + "/data").count() == 6020


def test_ranges_keep_their_files_where_a_session_deals_rows_to_more_partitions(spark, monkeypatch):
    df = spark.range(4000).select("id", F.floor(F.col("id") / 1000).alias("p"))
    dealt = type(df).repartition
    monkeypatch.setattr(type(df), "repartition", lambda self, n, *cols: dealt(self, max(n, 23), *cols))
    path, files = src.stage_topic(spark, "dealt", (storage.fresh_path(spark, "k"),), lambda: df, "p", 4, rows_per_file=400)
    assert files == 3 and storage.count_files(spark, path + "/data", ".parquet") == 12
    assert spark.read.parquet(path + "/data").distinct().count() == 4000


def test_resolutions_follow_runs(spark):
    rows = [("A", "x", h * 3_600_000, 1.0, 3_600_000) for h in (1, 2, 3, 7, 9, 10)]
    held = aq.al.hold_states(spark.createDataFrame(rows, "alert string, lkey string, t long, value double, for_ms long"), 3_600_000)
    ends = aq.al.resolutions(held, 3_600_000).collect()
    assert sorted((r.active_since // 3_600_000, r.t // 3_600_000) for r in ends) == [(1, 4), (9, 11)]


def test_ratio_runs_in_a_session_without_a_named_state_store(spark):
    named = spark.conf.get(tables.STATE_STORE)
    spark.conf.unset(tables.STATE_STORE)
    try:
        a, b = _samples(1, 20), [(s, k, t, i, v * 2) for s, k, t, i, v in _samples(1, 20)]
        left, right = (_stream(spark, [*rows, CLOSE], SAMPLES, lambda r: r[2], files=2) for rows in (a, b))
        sides = [panes.vector_stream(s(), "instant", 300_000, 60_000) for s in (left, right)]
        got, _ = _put_out(spark, panes.divided(*sides, ts.ieee_divide), "t long, lkey string, value double")
        found = got.where("lkey <> '-' and not isnan(value)").collect()
        assert found and {r.value for r in found} == {0.5}
    finally:
        spark.conf.set(tables.STATE_STORE, named)


@pytest.mark.parametrize("kind", ["rate", "delta", "instant"])
def test_unknown_and_infinite_readings_follow_the_sql(spark, kind):
    """A null reading counts as a sample without a value; a NaN, and infinity less infinity, is a value."""
    import duckdb
    rng, inf = random.Random(5), float("inf")
    odd = [None, None, None] if kind == "rate" else [None, None, float("nan"), inf, inf, -inf]
    gap = range(T0 + 1_500_000, T0 + 2_700_000)                                    # all null
    rows = [(s, k, t, i, None if t in gap else rng.choice(odd) if rng.random() < 0.4 or t < T0 + 900_000 else v)
            for s, k, t, i, v in _samples(5, 90)]
    con = duckdb.connect()
    con.execute("CREATE TABLE s (series VARCHAR, lkey VARCHAR, ts BIGINT, sample_id BIGINT, value DOUBLE)")
    con.executemany("INSERT INTO s VALUES (?, ?, ?, ?, ?)", rows)
    src_sql = "(SELECT *, 'm' AS metric, MAP {'s': series} AS labels FROM s)"
    cte = {"rate": lambda: q.increase("v", src_sql, 300_000, 60_000, True), "delta": lambda: q.delta("v", src_sql, 300_000, 60_000),
           "instant": lambda: q.instant("v", src_sql, 60_000, 300_000)}[kind]()
    shown = lambda v: None if v is None else str(round(v, 6) + 0.0)                # noqa: E731
    want = sorted((k, t, shown(v)) for k, t, v in con.execute(f"WITH {cte} SELECT lkey, t, value FROM v").fetchall())
    stream = _stream(spark, [*rows, CLOSE], SAMPLES, lambda r: r[2])
    got, _ = _put_out(spark, panes.vector_stream(stream(), kind, 300_000, 60_000).select("t", "lkey", "value"),
                      "t long, lkey string, value double")
    found = [(r.lkey, r.t, shown(r.value)) for r in got.where("lkey <> '-'").collect()]
    assert sorted(found, key=repr) == sorted(want, key=repr)
    values = {v for _, _, v in found}
    assert None in values and (kind == "rate" or {"nan", "inf", "-inf"} <= values)


def test_hopping_average_leaves_out_unknown_units(spark):
    schema = "event_time timestamp, orderunits double, address struct<state: string>"
    from datetime import datetime
    at = lambda minute: datetime.fromtimestamp(T0 // 1000 // 3600 * 3600 + 60 * minute)      # noqa: E731
    rows = [(at(0), None, ("X",)), (at(0), 4.0, ("X",)), (at(1), None, ("X",)), (at(2), 8.0, ("X",)), (at(9), None, ("X",)),
            (at(10**6), 0.0, ("-",))]
    stream = _stream(spark, rows, schema, lambda r: r[0], files=2)()
    got, _ = _put_out(spark, panes.hopping_by_state(stream, 300_000, 60_000, "1 minute"),
                      "state string, window_start long, window_end long, order_count long, avg_units double")
    base = T0 // 3_600_000 * 3600
    found = {(r.window_start // 1000 - base) // 60: (r.order_count, r.avg_units) for r in got.where("state = 'X'").collect()}
    assert found == {-4: (2, 4.0), -3: (3, 4.0), -2: (4, 6.0), -1: (4, 6.0), 0: (4, 6.0), 1: (2, 8.0), 2: (1, 8.0),
                     5: (1, None), 6: (1, None), 7: (1, None), 8: (1, None), 9: (1, None)}
