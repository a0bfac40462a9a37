"""Hand-computed fixtures for the operators' edge cases."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rivulet.functions.labels import labels_key
from rivulet.operators import alerts as al
from rivulet.operators import rewrite as rw
from rivulet.operators import timeseries as ts
from rivulet.operators.flatten import flatten
from rivulet import rulesets as RS

MIN = 60_000


def samples(spark, rows, metric="m"):
    """rows: (labels dict, ts_ms, value)"""
    data = [(metric, lab, t, i, float(v)) for i, (lab, t, v) in enumerate(rows)]
    df = spark.createDataFrame(data, "metric string, labels map<string,string>, ts long, sample_id long, value double")
    return df.select("metric", "labels", labels_key("labels").alias("lkey"),
                     F.concat("metric", labels_key("labels")).alias("series"), "ts", "sample_id", "value")


def at(df, t_ms):
    return {r["lkey"]: r["value"] for r in df.where(F.col("t") == t_ms).collect()}


def test_counter_increase_with_reset(spark):
    s = samples(spark, [({"i": "a"}, k * MIN, v) for k, v in enumerate([0, 10, 20, 5, 15])])
    inc = ts.increase(s, 5 * MIN, MIN)
    assert at(inc, 4 * MIN) == {'{i="a"}': 35.0}
    r = ts.rate(s, 5 * MIN, MIN)
    assert at(r, 4 * MIN)['{i="a"}'] == pytest.approx(35.0 / 300)
    # a window holding a single sample yields nothing
    assert at(ts.increase(s, 30_000, MIN), 0) == {}


def test_delta_with_missing_sample(spark):
    s = samples(spark, [({"i": "g"}, 0, 5.0), ({"i": "g"}, MIN, 7.0), ({"i": "g"}, 3 * MIN, 4.0)])
    d = ts.delta(s, 5 * MIN, MIN)
    assert at(d, 3 * MIN) == {'{i="g"}': -1.0}       # 4 - 5 over (t-5m, t]
    assert at(d, 2 * MIN) == {'{i="g"}': 2.0}        # only the first two samples
    assert at(d, 0) == {}


def test_instant_lookback_and_staleness(spark):
    s = samples(spark, [({"i": "x"}, 30_000, 1.0), ({"i": "x"}, 90_000, 2.0)])
    v = ts.instant(s, MIN, 5 * MIN)
    assert at(v, MIN) == {'{i="x"}': 1.0}
    assert at(v, 2 * MIN) == {'{i="x"}': 2.0}
    assert at(v, 6 * MIN) == {'{i="x"}': 2.0}        # 90 s sample still inside (t-5m, t]
    assert at(v, 7 * MIN) == {}                       # stale


def test_sum_of_empty_vector_is_empty(spark):
    s = samples(spark, [({"job": "a"}, 0, 1.0)])
    v = ts.compare(ts.instant(s, MIN, 5 * MIN), "==", 0)
    assert ts.aggregate(v, "sum").count() == 0


def test_ratio_missing_partner_and_zero_denominator(spark):
    a = samples(spark, [({"p": "1"}, 0, 2.0), ({"p": "2"}, 0, 3.0), ({"p": "3"}, 0, 0.0)], "a")
    b = samples(spark, [({"p": "1"}, 0, 0.0), ({"p": "3"}, 0, 0.0)], "b")
    r = ts.binary(ts.instant(a, MIN, 5 * MIN), ts.instant(b, MIN, 5 * MIN), "/")
    got = at(r, 0)
    assert got['{p="1"}'] == float("inf")
    assert got['{p="3"}'] != got['{p="3"}']          # NaN
    assert '{p="2"}' not in got                      # no partner, dropped


def test_topk_and_count_nonzero(spark):
    s = samples(spark, [({"p": str(i)}, 0, float(i)) for i in range(6)])
    v = ts.instant(s, MIN, 5 * MIN)
    assert set(at(ts.topk(v, 3), 0)) == {'{p="5"}', '{p="4"}', '{p="3"}'}
    assert ts.count_nonzero(v).where("t = 0").first()["value"] == 5


def test_label_replace_full_match(spark):
    s = samples(spark, [({"persistentvolumeclaim": "data0-kafka-1"}, 0, 1.0),
                        ({"persistentvolumeclaim": "xdata0-kafka-2"}, 0, 1.0)])
    v = ts.label_replace(ts.instant(s, MIN, 5 * MIN), "instance", "$1", "persistentvolumeclaim", "data0-(.*)")
    keys = set(at(v, 0))
    assert '{instance="kafka-1",persistentvolumeclaim="data0-kafka-1"}' in keys
    assert '{persistentvolumeclaim="xdata0-kafka-2"}' in keys


def _active(spark, rows):
    df = spark.createDataFrame(rows, "alert string, lkey string, t long, value double, for_ms long")
    return {r.t: r.state for r in al.hold_states(df, MIN).collect()}


@pytest.mark.parametrize("minutes, fires_at", [(4, None), (5, 5), (6, 5)])
def test_for_hold(spark, minutes, fires_at):
    rows = [("A", "{}", k * MIN, 1.0, 5 * MIN) for k in range(minutes + 1)]
    st = _active(spark, rows)
    firing = sorted(t for t, s in st.items() if s == "firing")
    assert (firing[0] // MIN if firing else None) == fires_at


def test_for_hold_gap_restarts(spark):
    steps = [0, 1, 2, 3, 5, 6, 7, 8, 9, 10]          # step 4 missing
    st = _active(spark, [("A", "{}", k * MIN, 1.0, 5 * MIN) for k in steps])
    assert st[3 * MIN] == "pending" and st[9 * MIN] == "pending" and st[10 * MIN] == "firing"


def test_annotation_templates(spark):
    df = spark.createDataFrame([({"env": "dev"}, 0.7512, 123456789.0)], "labels map<string,string>, v double, b double")
    r = df.select(al.render("env {{ $labels.env }} is {{ $value }}", F.col("labels"), F.col("v")).alias("a"),
                  al.render("{{ $value | humanizePercentage }}", F.col("labels"), F.col("v")).alias("p"),
                  al.render("{{ $value | humanize }}B/s", F.col("labels"), F.col("b")).alias("h")).first()
    assert r.a == "env dev is 0.7512"
    assert r.p == "75.12%"
    assert r.h == "123.5MB/s"


def test_severity_levels(spark):
    df = spark.createDataFrame([("page",), ("critical",), ("warning",), ("info",)], "s string")
    assert [r[0] for r in df.select(al.severity_level(F.col("s"))).collect()] == [0, 1, 2, 3]


def test_severity_tiers(spark):
    tiers = spark.createDataFrame([("lag", "warning", ">", 10000.0, 300.0), ("lag", "critical", ">", 100000.0, 300.0)],
                                  al.TIER_SCHEMA)
    sig = spark.createDataFrame([("lag", 5000.0), ("lag", 50000.0), ("lag", 500000.0)], "signal string, value double")
    got = sorted((r.value, r.tier) for r in al.tier_matches(sig, tiers).collect())
    assert got == [(50000.0, "warning"), (500000.0, "critical"), (500000.0, "warning")]


def test_bean_rules_first_match_wins_and_unmatched_dropped(spark):
    beans = spark.createDataFrame([
        ("kafka", "kafka.server<type=BrokerTopicMetrics, name=MessagesInPerSec, topic=Orders><>Count: 7.0", 7.0),
        ("kafka", "java.lang<type=Memory><HeapMemoryUsage>used: 5", 5.0),
        ("kafka", "kafka.network<type=RequestMetrics, name=TotalTimeMs, request=Produce><>99thPercentile: 3.0", 3.0),
        ("connect", "kafka.connect<type=app-info, client-id=connect-1><>version: 7.6.0", None),
        ("connect", "java.lang<type=Runtime><>Uptime: 12", 12.0),
    ], "component string, bean string, value double")
    out = {(r.component, r.metric): (r.lkey, r.value) for r in
           rw.apply_bean_rules(beans, {"kafka": RS.KAFKA_RULES, "connect": RS.CONNECT_RULES}).collect()}
    # the generic one-extra-pair rule precedes the BrokerTopicMetrics rule
    assert out[("kafka", "kafka_server_BrokerTopicMetrics_MessagesInPerSec")] == ('{topic="Orders"}', 7.0)
    assert out[("kafka", "kafka_network_RequestMetrics_TotalTimeMs")] == (
        '{quantile="0.99",request="Produce"}', 3.0)
    assert out[("connect", "kafka_connect_app_info")] == ('{client_id="connect-1",version="7.6.0"}', 1.0)
    assert out[("connect", "java_lang_Runtime_Uptime")] == ("{}", 12.0)
    assert not any(m.startswith("jvm_") for _, m in out)   # no kafka rule for java.lang


def test_relabel_actions(spark):
    df = spark.createDataFrame([
        ({"__address__": "kafka-0.kafka.confluent.svc.cluster.local:7778", "__meta_kubernetes_pod_label_app": "kafka",
          "__meta_kubernetes_service_name": "kafka"},),
        ({"__address__": "other:1", "__meta_kubernetes_pod_label_app": "connectx",
          "__meta_kubernetes_service_name": "kafka-0-internal"},)], "labels map<string,string>")
    keep = rw.relabel(df, [rw.Relabel("keep", ("__meta_kubernetes_pod_label_app",), "kafka")])
    assert keep.count() == 1
    drop = rw.relabel(df, [rw.Relabel("drop", ("__meta_kubernetes_service_name",), ".*-[0-9]+-internal")])
    assert drop.count() == 1
    rep = rw.relabel(df, RS.BROKER_RELABEL).select(F.col("labels")["instance"].alias("i"),
                                                   F.col("labels")["env"].alias("e")).collect()
    assert sorted((r.i or "", r.e) for r in rep) == [("", "dev-eks"), ("kafka-0", "dev-eks")]
    lm = rw.relabel(df, RS.LABELMAP_RELABEL).select(F.col("labels")["app"].alias("a")).collect()
    assert sorted(r.a for r in lm) == ["connectx", "kafka"]
    # a regex must match the whole value
    part = rw.relabel(df, [rw.Relabel("keep", ("__meta_kubernetes_pod_label_app",), "connect")])
    assert part.count() == 0


def test_flatten_and_concat_with_nulls(spark):
    sch = "id int, address struct<city:string,state:string,zipcode:bigint>"
    df = spark.createDataFrame([(1, None), (2, ("A", None, 5))], sch)
    rows = {r.id: r for r in flatten(df).collect()}
    assert rows[1].address_city is None and rows[1].address_zipcode is None
    assert rows[2].address_state is None and rows[2].address_zipcode == 5
    loc = {r.id: r.l for r in df.select("id", F.concat("address.city", F.lit(", "), "address.state").alias("l")).collect()}
    assert loc == {1: None, 2: None}


def test_orders_by_state_approx_distinct(spark):
    from rivulet.operators import orders as op
    rows = [(str(i), i, f"Item_{i % 7}", 1.0, ("c", "S" if i % 2 else "T", 1)) for i in range(200)]
    df = spark.createDataFrame(rows, "orderid string, ordertime long, itemid string, orderunits double, "
                                     "address struct<city:string,state:string,zipcode:bigint>")
    exact = {r.state: r.unique_items for r in op.orders_by_state(df).collect()}
    approx = {r.state: r.unique_items for r in op.orders_by_state(df, approx=True).collect()}
    assert exact == approx == {"S": 7, "T": 7}


def test_orders_by_state_from_state_items(spark):
    from rivulet.operators import orders as op
    from rivulet.streaming import tables
    rows = [(str(i), i, f"Item_{i % 7}", 1.0, ("c", "S" if i % 2 else "T", 1)) for i in range(50)] + [("x", 1, "i", 1.0, None)]
    df = spark.createDataFrame(rows, "orderid string, ordertime long, itemid string, orderunits double, "
                                     "address struct<city:string,state:string,zipcode:bigint>")
    assert sorted(map(repr, tables.by_state(tables.state_items(df)).collect())) == sorted(map(repr, op.orders_by_state(df).collect()))


def test_number_text_has_no_limits(spark):
    from rivulet.functions.labels import go_float_text
    want = {1e30: "1e+30", 1e-12: "1e-12", float("inf"): "+Inf", float("-inf"): "-Inf", 0.0: "0", 1.0: "1", 0.25: "0.25",
            12345678.5: "12345678.5", 1e20: "100000000000000000000", 1e21: "1e+21", 0.0001: "0.0001", 0.00009: "9e-05",
            -350000000.0: "-350000000", 123456789012.125: "123456789012.125"}
    df = spark.createDataFrame([(v,) for v in want] + [(float("nan"),), (None,)], "v double")
    got = {repr(r.v): r.t for r in df.select("v", go_float_text("v").alias("t")).collect()}
    assert got == {repr(v): t for v, t in want.items()} | {"nan": "NaN", "None": "<nil>"}


def test_annotations_render_any_number(spark):
    df = spark.createDataFrame([(float("inf"),), (1e30,), (1e-12,), (float("nan"),), (0.7146,)], "v double")
    no = F.create_map().cast("map<string,string>")
    got = [tuple(r) for r in df.select(*[al.render("{{ $value%s }}" % f, no, F.col("v")) for f in
                                         ("", " | humanizePercentage", " | humanize")]).collect()]
    assert got == [("+Inf", "+Inf%", "+Inf"), ("1e+30", "1e+32%", "1000000Y"), ("1e-12", "1e-10%", "1e-12"),
                   ("NaN", "NaN%", "NaN"), ("0.7146", "71.46%", "0.7146")]


def test_producer_lines_lose_nothing(spark):
    from rivulet.operators import topics as tp
    lines = ["h1:a,h2:b\tk:v:w", "nokeyline", "h1:a\tnokey", "h1:a,h1:b\tk:v", "h\tk:", "\tk:v", None]
    got = {r.line: r for r in tp.parse_producer_lines(spark.createDataFrame([(x,) for x in lines], "line string")).collect()}
    assert (got[lines[0]].key, got[lines[0]].value, got[lines[0]].error) == ("k", "v:w", None)
    assert [tuple(h) for h in got[lines[0]].headers] == [("h1", "a"), ("h2", "b")]
    assert (got[lines[1]].key, got[lines[1]].value, got[lines[1]].error) == (None, "nokeyline", "no headers delimiter")
    assert (got[lines[2]].key, got[lines[2]].value, got[lines[2]].error) == (None, "nokey", "no key separator")
    assert [tuple(h) for h in got[lines[3]].headers] == [("h1", "a"), ("h1", "b")]      # repeated headers are legal
    assert [tuple(h) for h in got[lines[4]].headers] == [("h", None)] and got[lines[4]].value == ""
    assert got[lines[5]].headers == [] and got[lines[5]].key == "k" and got[None].error == "null line"
    wide = tp.parse_producer_lines(spark.createDataFrame([("a=>1||b=>2##k'||vv",)], "line string"), key_separator="||",
                                   headers_delimiter="##", headers_separator="||", header_key_separator="=>").first()
    assert (wide.key, wide.value, [tuple(h) for h in wide.headers]) == ("k'", "vv", [("a", "1"), ("b", "2")])


def test_storage_sizing_counts_bytes(spark):
    from rivulet.operators import topics as tp
    df = spark.createDataFrame([("T", 0, "ké", "ñ中"), ("T", 1, None, "ab"), ("T", 2, "k", None)], "topic string, timestamp long, key string, value string")
    assert tp.storage_required(df, 1, 1, 1, 1.0).first()["daily_bytes"] == 3 + 5 + 2 + 1


def test_repeated_label_names_keep_the_last(spark):
    df = spark.createDataFrame([({"__meta_a_x": "1", "__meta_b_x": "2", "y": "3"},)], "labels map<string,string>")
    out = rw.relabel(df, [rw.Relabel("labelmap", regex="__meta_[ab]_(.+)")]).first()["labels"]
    assert out["x"] == "2" and out["y"] == "3"
    beans = spark.createDataFrame([("c", "d<type=T, a-b=1, a_b=2><>Count: 5", 5.0)], "component string, bean string, value double")
    rules = {"c": (rw.BeanRule(r"d<type=(.+), (.+)=(.+), (.+)=(.+)><>Count", "d_$1", {"$2": "$3", "$4": "$5"}),)}
    assert rw.apply_bean_rules(beans, rules).first()["lkey"] == '{a_b="2"}'


def test_checkpoint_folder_is_required_off_local_mode():
    from rivulet.session import checkpoint_root

    class Fake:
        class conf:
            @staticmethod
            def get(key, default=None):
                return default

        class sparkContext:
            master = "spark://host:7077"
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        checkpoint_root(Fake)
