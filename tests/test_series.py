"""Vectors by label-set id equal those by label text, and their exchanges carry no labels."""

import re

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from conftest import SMALL
from rivulet.operators import series
from rivulet.operators import timeseries as ts
from rivulet.plans import metric_queries as m
from rivulet.sources.samples import SampleSource

HEAP = [("area", "=", "heap")]
USED, MOST = "jvm_memory_bytes_used", "jvm_memory_bytes_max"


def _rows(vec):
    return sorted((r.t, r.lkey, tuple(sorted(r.labels.items())), round(r.value, 6)) for r in vec.collect())


@pytest.mark.parametrize("metric, function, args", [
    (m.CPU, ts.rate, (m.DRANGE, m.DSTEP)), (m.CPU, ts.increase, (m.DRANGE, m.DSTEP)),
    (m.LAG, ts.delta, (m.DRANGE, m.DSTEP)), (USED, ts.instant, (m.DSTEP, m.DLOOKBACK))])
def test_by_id_equals_by_text(spark, metric, function, args):
    s = SampleSource(spark, SMALL)
    got = _rows(series.named(function(s.by_id(metric), *args), s.catalogue(metric)))
    assert got and got == _rows(function(ts.select_series(s, metric), *args))


def test_ratio_matches_across_metrics(spark):
    s, step = SampleSource(spark, SMALL), (m.DSTEP, m.DLOOKBACK)
    got = ts.binary(ts.instant(s.by_id(USED, HEAP), *step), ts.instant(s.by_id(MOST, HEAP), *step), "/")
    want = ts.binary(ts.instant(ts.select_series(s, USED, HEAP), *step), ts.instant(ts.select_series(s, MOST, HEAP), *step), "/")
    got = _rows(series.named(got, s.catalogue(USED, MOST)))
    assert got and got == _rows(want)


def test_stored_samples_are_selected_through_the_catalogue(spark):
    s = SampleSource(spark, SMALL)
    metric, matchers = "up", [("job", "=~", "kafka-.*"), ("pod", "!=", "kafka-0"), ("absent", "=", "")]
    stored = s.by_id(metric)
    got = stored.join(series.select_ids(s.catalogue(metric), matchers), "lid", "left_semi")
    assert sorted(got.collect()) == sorted(s.by_id(metric, matchers).select(*got.columns).collect())
    assert 0 < got.count() < stored.count()


@pytest.mark.parametrize("name", ["rate_dense", "delta_dense", "ratio_vector"])
def test_no_labels_in_exchanges_of_samples_and_vectors(spark, name):
    plan = getattr(m, f"q_{name}")(spark, SMALL)._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    exchanged = [x for x in re.findall(r"\(\d+\) Exchange\nInput \[\d+\]: \[(.*?)\]\n", plan)]
    rows = [x for x in exchanged if "lid#" in x and "lkey#" not in x]
    assert rows and not any(re.search(r"labels|entries|series", x) for x in rows)
    sets = [x for x in exchanged if x not in rows]                      # the catalogue's own
    assert sets and not any(re.search(r"\bts#|\bt#|sample_id#|value#", x) for x in sets)


def test_clashing_ids_are_an_error(spark, monkeypatch):
    df = spark.sql("select map('a', '1') as labels union all select map('a', '2')")
    assert series.catalogue(df).count() == 2
    monkeypatch.setattr(series, "label_id", lambda key: F.substring(key, 1, 2))
    with pytest.raises(PySparkException, match="share an id"):
        series.catalogue(df).collect()


def test_empty_and_repeated_label_sets(spark):
    df = spark.sql("select cast(map() as map<string,string>) as labels union all select map('b', '1', 'a', '2') union all select map('a', '2', 'b', '1')")
    got = {r.lkey: r.labels for r in series.catalogue(df).collect()}
    assert got == {"{}": {}, '{a="2",b="1"}': {"a": "2", "b": "1"}}
    assert series.catalogue(df.where("false")).count() == 0
