"""The stored log opens matching files only; merged histories and lag against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from rivulet.operators.sequence import carry_forward
from rivulet.operators.topics import lag_over_time
from rivulet.sources.log import stored_log, write_log
from rivulet.sources.topic import commit_history, order_records
from rivulet.streaming import storage


@pytest.fixture(scope="module")
def log(spark):
    return write_log(order_records(spark, SMALL), storage.fresh_path(spark, "test-log"), rows_per_segment=20)


def _files(df):
    """(partition, segment) of the files that hold the rows."""
    return {(r.partition, r.segment) for r in df.select("partition", "segment").distinct().collect()}


def _opened(df):
    """Files that the scan of a plan without exchanges opened."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().collectLeaves().apply(0).metrics().apply("numFiles").value()


def _rows(df):
    return sorted(df.select("topic", "partition", "offset", "timestamp", "key", "value").collect())


def test_segments_are_equally_large_and_sorted(log):
    sizes = {(r.partition, r.segment): r["count"] for r in log.records.groupBy("partition", "segment").count().collect()}
    most = {}
    for p, s in sizes:
        most[p] = max(most.get(p, 0), s)
    assert all(n == 20 for (p, s), n in sizes.items() if s < most[p])
    index = {(r.partition, r.segment): r for r in log.index.collect()}
    assert set(index) == set(sizes)
    assert all(r.first_offset == 20 * s for (_, s), r in index.items())


def test_position_reads_only_matching_folders(spark, log):
    got = log.from_partition_offset("Orders", 2, 70)
    want = order_records(spark, SMALL).where("partition = 2 and offset >= 70")
    assert _rows(got) == _rows(want)
    assert _opened(got) == log.index.where("partition = 2 and segment >= 3").count()


def test_time_prunes_folders_at_run_time(spark, log):
    ts = 1705276800000
    got = log.from_timestamp(ts)
    assert _rows(got) == _rows(order_records(spark, SMALL).where(F.col("timestamp") >= ts))
    assert "dynamicpruning" in got._jdf.queryExecution().toString()
    matching = {(r.partition, r.segment) for r in log.index.where(F.col("last_timestamp") >= ts).collect()}
    assert _files(got) == matching and len(matching) < log.index.count()


def test_first_records_come_from_first_segments(spark, log):
    got = log.first(10)
    want = order_records(spark, SMALL).orderBy("timestamp", "partition", "offset").limit(10)
    assert _rows(got) == _rows(want)
    assert _opened(got) == log.index.where("segment = 0").count() < log.index.count()


def test_log_is_written_once_per_key(spark):
    records = order_records(spark, SMALL)
    a = stored_log(spark, "test-once", ("k", 1), lambda: records, rows_per_segment=50)
    b = stored_log(spark, "test-once", ("k", 1), lambda: records, rows_per_segment=50)
    assert a.records.schema == b.records.schema
    assert sorted(a.records.inputFiles()) == sorted(b.records.inputFiles())
    assert _rows(b.records) == _rows(records)


def test_empty_topic(spark):
    log = write_log(order_records(spark, SMALL).where("false"), storage.fresh_path(spark, "test-log"))
    assert log.from_timestamp(0).count() == log.first(3).count() == log.from_partition_offset("Orders", 0, 0).count() == 0


@pytest.mark.parametrize("width", [7, 100, 10_000])
def test_carry_forward(spark, width):
    rnd = random.Random(width)
    rows = [(k, t, rnd.choice([None, rnd.randrange(100)]), rnd.choice([None, rnd.randrange(100)]))
            for k in ("a", "b", None) for t in rnd.sample(range(-200, 500), 60)]
    df = spark.createDataFrame(rows, "k string, t long, a long, b long")
    want = set()
    for k in ("a", "b", None):
        mine = sorted((r for r in rows if r[0] == k), key=lambda r: r[1])
        a = b = None
        for i, (_, t, x, y) in enumerate(mine):
            a = a if x is None else x
            b = b if y is None else y if b is None else max(b, y)
            want.add((k, t, a, b, mine[i + 1][1] if i + 1 < len(mine) else None))
    got = carry_forward(df, ["k"], "t", ["a"], width, largest=["b"]).select("k", "t", "a", "b", "_next").collect()
    assert len(got) == len(rows) and {tuple(r) for r in got} == want


def _lag(records, commits, step):
    """A plain loop over every step."""
    out = set()
    last = max(-(-t // step) * step for t in [r[3] for r in records] + [c[3] for c in commits])
    for g, p in {(c[0], c[2]) for c in commits}:
        for t in range(0, last + 1, step):
            made = [(c[3], c[4], c[5]) for c in commits if c[0] == g and c[2] == p and c[3] <= t]
            ends = [r[2] + 1 for r in records if r[1] == p and r[3] <= t]
            if made and ends:
                position = max(made)[2]
                out.add((g, p, t, position, max(ends), max(ends) - position))
    return out


def test_lag_over_time_with_late_records_rewinds_and_ties(spark):
    rnd = random.Random(5)
    records = [("T", p, o, max(0, o * 37 + rnd.randrange(-200, 200))) for p in range(3) for o in range(60)]     # times out of order
    commits = [(g, "T", p, rnd.randrange(0, 3000) // 50 * 50, i, rnd.randrange(0, 60))                          # ties, moves back
               for g in ("a", "b") for p in (0, 1, 3) for i in range(25)]                                       # partition 3 has no records
    r = spark.createDataFrame(records, "topic string, partition int, offset long, timestamp long")
    c = spark.createDataFrame(commits, "`group` string, topic string, partition int, committed_at long, commit_id long, position long")
    for step, bucket in ((50, 3), (130, 1440)):
        got = lag_over_time(r, c, step, bucket).select("group", "partition", "t", "current_offset", "log_end_offset", "lag").collect()
        assert len(got) == len(set(got)) and {tuple(x) for x in got} == _lag(records, commits, step)
    assert lag_over_time(r, c.where("false"), 50).count() == 0


def test_commits_are_taken_back(spark):
    got = commit_history(order_records(spark, SMALL, value=False))
    back = got.where((F.col("commit_id") % 2) == 1)
    assert back.count() > 0 and back.where("position * 2 >= commit_id - 1").count() == 0
