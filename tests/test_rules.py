"""Rule sets over many samples per step."""

import random

from pyspark.sql import functions as F

from rivulet.functions.labels import labels_key
from rivulet.plans import rules
from rivulet.plans.vexpr import Bin, Cmp, Delta, Inst, Params, Rate

P = Params(step_ms=60_000, lookback_ms=150_000)
TREES = {"level": Cmp(">", 3, Inst("gauge")), "moved": Cmp("!=", 0, Delta("gauge", (), 120_000)),
         "odd": Cmp("!=", 0, Delta("other", (), 90_000)), "speed": Cmp(">", 0, Rate("counter", (), 120_000))}


class Source:
    def __init__(self, spark):
        rng = random.Random(5)
        rows = [(m, s, 1_700_000_000_000 + 60_000 * rng.choice([0, 1, 2, 3, 7, 8]) + rng.randint(-500, 500) * rng.choice([0, 30, 60]),
                 i, float(rng.randint(0, 9))) for i, (m, s) in enumerate([("gauge", "a"), ("gauge", "b"), ("other", "a"), ("counter", "a")] * 120)]
        made = spark.createDataFrame(rows, "metric string, s string, ts long, sample_id long, value double")
        made = made.withColumn("labels", F.create_map(F.lit("s"), F.col("s"))).withColumn("lkey", labels_key("labels"))
        self.rows = made.withColumn("series", F.concat("metric", "lkey"))

    def for_metrics(self, metrics):
        return self.rows.where(F.col("metric").isin(list(metrics)))

    def for_metric(self, metric):
        return self.for_metrics([metric])


def test_rules_keep_what_a_step_can_take(spark):
    source = Source(spark)
    got = sorted((r.rule, r.t, r.lkey, round(r.value, 6)) for r in rules.evaluate(source, TREES, P).collect())
    want = sorted((n, r.t, r.lkey, round(r.value, 6)) for n, tree in TREES.items() for r in tree.df(source, P).collect())
    assert got == want and len({n for n, *_ in got}) == len(TREES)


def test_rules_window_few_samples_of_a_step(spark):
    uses = [u for n in ("level", "moved") for u in rules.read_rule(n, TREES[n]).uses]
    kept = rules._needed(Source(spark), uses, P).groupBy("series", F.ceil(F.col("ts") / P.step_ms)).count()
    assert kept.agg(F.max("count")).first()[0] == 2


def test_rates_are_exact_sums_divided_once(spark):
    """Equal to the last bit, whatever the order in which rises are added."""
    source, ratio = Source(spark), Cmp(">", 0, Bin("/", Rate("counter", (), 120_000), Rate("other", (), 180_000)))
    trees = {"speed": TREES["speed"], "ratio": ratio}
    got = sorted((r.rule, r.t, r.lkey, repr(r.value)) for r in rules.evaluate(source, trees, P).collect())
    want = sorted((n, r.t, r.lkey, repr(r.value)) for n, tree in trees.items() for r in tree.df(source, P).collect())
    assert got == want and {n for n, *_ in got} == set(trees)
