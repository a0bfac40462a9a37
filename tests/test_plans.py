"""Plan shape: pruned scans, pushed filters, partial aggregation."""

import re

import __spark_entry__ as entry
from conftest import SMALL
from rivulet.plans import alert_queries as aq
from rivulet.plans.catalog import explain
from rivulet.sources.beans import bean_readings


def _plan(spark, name):
    return explain(entry.queries()[name](spark, SMALL), "formatted")


def test_order_scans_are_pruned_and_aggregate_is_partial(spark):
    txt = _plan(spark, "orders_by_state")
    schemas = re.findall(r"ReadSchema: (struct<[^\n]*>)", txt)
    assert "struct<event_id:bigint,event_type:string,value:double>" in schemas
    assert all("c_acctbal" not in s and "o_totalprice" not in s and "props" not in s for s in schemas)
    # partial + final aggregation around the shuffle
    assert txt.count("HashAggregate") >= 2


def test_metric_selector_pushes_component_filter_to_scan(spark):
    txt = _plan(spark, "label_eq")
    pushed = re.findall(r"PushedFilters: \[([^\n]*)\]", txt)
    assert pushed and all("EqualTo(event_type,click)" in p for p in pushed)


def test_first_n_is_a_top_k(spark):
    txt = _plan(spark, "read_limit_n")
    assert "TakeOrderedAndProject" in txt          # top-k, not a global sort


def test_rule_chain_evaluated_once(spark):
    txt = _plan(spark, "percentile_label")
    sections = re.split(r"\n\(\d+\) ", txt)
    assert max(s.count("RLIKE") for s in sections) <= 29
    assert sum(s.count("RLIKE") for s in sections) <= 29 * 2


def test_bean_readings_are_compiled(spark):
    """The JVM interprets generated methods of 8,000 bytes and more."""
    modes = spark._jvm.org.apache.spark.sql.execution.ExplainMode
    spark.conf.set("spark.sql.adaptive.enabled", "false")          # adaptive plans have no code before they run
    try:
        made = bean_readings(spark, SMALL)._jdf.queryExecution().explainString(modes.fromString("codegen"))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", made)]
    assert sizes and max(sizes) < 8000


def test_series_sequences_shuffle_on_series_and_time_bucket(spark):
    """A hot series must not become one task: the lag/running-sum windows
    behind counters, rates and offsets hash-partition on (series, bucket)."""
    for name in ("rate_dense", "read_from_beginning"):
        txt = _plan(spark, name)
        parts = re.findall(r"Arguments: hashpartitioning\(([^)]*)\)", txt)
        assert any("_bucket" in p for p in parts), (name, parts)


def test_instant_vector_needs_no_aggregation_and_one_shuffle(spark):
    txt = _plan(spark, "instant_lookup").split("\n\n(1)")[0]
    assert "Aggregate" not in txt
    assert txt.count("Exchange") == 1


def test_range_functions_use_hash_aggregates(spark):
    for name in ("rate_dense", "delta_dense", "tag_avg_by"):
        txt = _plan(spark, name).split("\n\n(1)")[0]
        assert "SortAggregate" not in txt and "HashAggregate" in txt, name


def test_positions_and_items_read_events_only(spark):
    """No address join where the address isn't used."""
    for name in ("orders_by_item", "alias", "timestamp_to_string", "cast_varchar", "tumbling_1m", "window_bounds",
                 "windowed_lookup", "offsets_latest", "offsets_earliest", "topic_message_count", "consumer_lag",
                 "lag_by_topic", "offset_reset"):
        txt = _plan(spark, name)
        found = set(re.findall(r"Location: [^\n]*/(\w+)\.parquet", txt))
        assert found == {"events"}, (name, found)
        scans = len(re.findall(r"\n\(\d+\) Scan parquet", txt))
        assert scans <= 2, (name, scans)


def test_state_predicate_reaches_the_nation_scan(spark):
    assert re.search(r"PushedFilters: \[[^\n]*EqualTo\(n_name,NATION_1\)", _plan(spark, "filter_eq"))


def test_building_rules_runs_no_job(spark):
    """A rule set is one lazy plan: nothing is written or counted while it is built."""
    sc = spark.sparkContext
    source = aq.SampleSource(spark, SMALL)
    sc.setJobGroup("rules", "building")
    try:
        df = aq.evaluate(source, [r.alert for r in aq.RULES], aq.DENSE)
        txt = explain(df, "formatted")
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert not sc.statusTracker().getJobIdsForGroup("rules")
    assert txt.count("Scan parquet") <= 2 * 3                       # listed in the tree and in the details
    assert "Python" not in txt
