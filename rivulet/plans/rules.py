"""All expressions of a rule set as one lazy plan.

The rules are read as a small constant table of *uses*: which selector (metric, matchers), evaluated how (instant,
rate or delta), feeds which side of which rule, grouped by which labels.  Then

1. a bit mask says which uses a series has, and series without any are dropped below the shuffle; between two steps
   only the samples that a use can take are kept (``_needed``);
2. one window per (series, bucket) finds each sample's neighbours for all kinds of vector at once;
3. a sample is spread over the steps where it is an answer, for each of its uses.  Where a rule compares an instant
   vector itself, samples that fail the comparison are dropped before that;
4. one hash aggregate, keyed by (rule, step, label set), adds up what a step of a rule consists of: a
   ``sum by`` or ``count``, the pairs of a rate, the first and last sample of a delta, both sides of a ratio;
5. the rule's comparison filters the result.

Nothing is written and no job runs while the plan is built.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import all_match, drop_empty, label, labels_key
from ..operators import timeseries as ts
from ..operators.sequence import neighbor_within
from .vexpr import Agg, Bin, Cmp, Delta, Inst, Node, Params, Rate


@dataclass(frozen=True)
class Use:
    """One selector's part in a rule."""

    rule: str
    side: int
    leaf: Node                       # Inst, Rate or Delta
    keep: tuple | None               # (op, number) that a sample must meet, for instant vectors
    by: tuple | None                 # labels kept; None: all


@dataclass(frozen=True)
class Rule:
    name: str
    uses: tuple[Use, ...]
    fn: str                          # sum | count | ratio
    keep: tuple | None               # (op, number) that the result must meet


def read_rule(name: str, tree: Node) -> Rule:
    """The uses of an expression: [compare] (vector | sum/count by (vector) | side / side)."""
    keep, node = ((tree.op, tree.value), tree.child) if isinstance(tree, Cmp) else (None, tree)
    if isinstance(node, Bin):
        if node.op != "/":
            raise ValueError(f"{name}: only ratios of vectors can be read")
        uses = tuple(_use(name, side, part, None)[0] for side, part in enumerate((node.left, node.right)))
        return Rule(name, uses, "ratio", keep)
    use, fn = _use(name, 0, node, keep)
    return Rule(name, (use,), fn, keep)


def _use(name: str, side: int, node: Node, keep: tuple | None) -> tuple[Use, str]:
    fn, by, inner = "sum", None, keep
    if isinstance(node, Agg):
        fn, by, inner, node = node.fn, tuple(node.by), None, node.child
        if isinstance(node, Cmp):
            inner, node = (node.op, node.value), node.child
    if not isinstance(node, (Inst, Rate, Delta)) or fn not in ("sum", "count") or (by is not None and isinstance(node, Delta)):
        raise ValueError(f"{name}: this form of expression can't be read")
    return Use(name, side, node, inner if isinstance(node, Inst) else None, by), fn


def _case(on: Column, cases: Mapping, otherwise=None) -> Column:
    """A value per rule or use; equal values share a branch."""
    shared: dict = {}
    for k, v in cases.items():
        shared.setdefault(v, []).append(k)
    made = None
    for v, ks in shared.items():
        hit = on.isin(ks)
        made = F.when(hit, v) if made is None else made.when(hit, v)
    return made if otherwise is None else made.otherwise(otherwise)


def _uses_of(uses: Sequence[Use]) -> Column:
    """Bit mask of the uses whose selector takes a sample."""
    by_metric: dict[str, list] = {}
    for i, u in enumerate(uses):
        by_metric.setdefault(u.leaf.metric, []).append((i, u))
    mask = F.lit(0).cast("long")
    for metric, members in by_metric.items():
        bits = F.lit(0).cast("long")
        for i, u in members:
            bit = F.lit(1 << i).cast("long")
            bits = bits.bitwiseOR(F.when(all_match("labels", u.leaf.matchers), bit).otherwise(F.lit(0).cast("long"))
                                  if u.leaf.matchers else bit)
        mask = mask.bitwiseOR(F.when(F.col("metric") == metric, bits).otherwise(F.lit(0).cast("long")))
    return mask


def _parts(i: int, u: Use, p: Params) -> list[Column]:
    """What a sample adds for a use: (use, first and last ms, value, id check), null where nothing."""
    at, nxt, prev, v = F.col("ts"), F.col("next_ts"), F.col("prev_ts"), F.col("value")

    def part(lo, hi, value, check, on):
        hit = F.col("uses").bitwiseAND(F.lit(1 << i).cast("long")) != 0
        return F.when(hit & on, F.struct(F.lit(i).alias("use"), lo.alias("lo"), hi.alias("hi"), value.alias("v"),
                                         check.cast("long").alias("check")))
    if isinstance(u.leaf, Inst):
        on = F.lit(True) if u.keep is None else ts.compare_values(v, *u.keep)
        end = at + F.lit(p.lookback_ms - 1)
        return [part(at, F.least(end, F.coalesce(nxt - F.lit(1), end)), v, F.lit(1), on)]
    rng = p.rng(u.leaf.range_ms)
    end = at + F.lit(rng - 1)
    if isinstance(u.leaf, Rate):
        rise = F.when(v >= F.col("prev_value"), v - F.col("prev_value")).otherwise(v)      # per second once they are added
        return [part(at, prev + F.lit(rng - 1), rise, F.lit(1), prev.isNotNull() & (at - prev < F.lit(rng)))]
    # last minus first: the sample is added where it is the last one, and subtracted where it is the first; where it
    # is both, its id cancels out in the check
    return [part(at, F.least(end, F.coalesce(nxt - F.lit(1), end)), v, F.col("sample_id"), F.lit(True)),
            part(F.greatest(at, F.coalesce(prev + F.lit(rng), at)), end, -v, -F.col("sample_id"), F.lit(True))]


def _added(rules: Sequence[Rule], side: int, column: str, p: Params) -> Column:
    """A side's total of each rule: of a rate's rises, divided by its range.

    One division of the total: quotients added up would depend on the order of the rows in their last digits."""
    total = F.col(column)
    ranges = {r.name: p.rng(u.leaf.range_ms) / 1000.0 for r in rules for u in r.uses if u.side == side and isinstance(u.leaf, Rate)}
    return F.when(F.col("rule").isin(list(ranges)), total / _case(F.col("rule"), ranges)).otherwise(total) if ranges else total


def _bits(chosen) -> Column:
    """Whether a sample has one of the uses with these numbers."""
    return F.col("uses").bitwiseAND(F.lit(sum(1 << i for i in chosen)).cast("long")) != 0


def _needed(source, uses: Sequence[Use], p: Params) -> DataFrame:
    """The samples that can be an answer at some step, with their ``uses``.

    Between two steps only the last sample of a series counts for an instant vector, and only the first and the last
    one for a delta over whole steps: these are found by an aggregate that starts in the scan's stage, so what is
    windowed and sorted grows with series and steps.  A rate takes every sample of its metric.
    """
    step = F.lit(p.step_ms)
    by_pair = [i for i, u in enumerate(uses) if isinstance(u.leaf, Rate) or (
        isinstance(u.leaf, Delta) and p.rng(u.leaf.range_ms) % p.step_ms)]
    edges = [i for i, u in enumerate(uses) if isinstance(u.leaf, Delta) and i not in by_pair]
    samples = source.for_metrics({u.leaf.metric for u in uses}).withColumn("uses", _uses_of(uses)).where(F.col("uses") != 0)
    moment, row = F.struct("ts", "sample_id"), F.struct("ts", "sample_id", "value")
    own = F.when(_bits(by_pair), row).alias("own")               # a group of its own for every sample that a rate takes
    last, first = F.max_by(row, moment).alias("last"), F.min_by(row, moment).alias("first")
    kept = (samples.groupBy("series", F.ceil(F.col("ts") / step).alias("pane"), own, "uses", "lkey", F.map_entries("labels").alias("entries"))
            .agg(last, F.count(F.lit(1)).cast("int").alias("n"), *([first] if edges else [])))
    chosen = F.when(F.col("own").isNotNull(), F.array_repeat("last", F.col("n")))
    if edges:
        apart = _bits(edges) & ((F.col("first.ts") != F.col("last.ts"))
                                | (F.col("first.sample_id") != F.col("last.sample_id")))
        chosen = chosen.when(apart, F.array("first", "last"))
    chosen = chosen.otherwise(F.array("last"))
    thin = kept.select("uses", F.map_from_entries("entries").alias("labels"), "lkey", "series", F.explode(chosen).alias("x"))
    return thin.select("uses", "labels", "lkey", "series", "x.ts", "x.sample_id", "x.value")


def evaluate(source, trees: Mapping[str, Node], p: Params) -> DataFrame:
    """``rule, t, labels, lkey, value`` of every expression, one plan for all."""
    rules = [read_rule(n, t) for n, t in trees.items()]
    uses = [u for r in rules for u in r.uses]
    if len(uses) > 63:
        raise ValueError("more than 63 selectors: evaluate the rules in groups")
    horizon = max(p.lookback_ms if isinstance(u.leaf, Inst) else p.rng(u.leaf.range_ms) for u in uses)
    samples = _needed(source, uses, p)
    near = neighbor_within(samples.select("uses", "labels", "lkey", "series", "ts", "sample_id", "value"),
                           ["series"], "ts", "sample_id", ["ts", "value"], horizon, "both")
    parts = [x for i, u in enumerate(uses) for x in _parts(i, u, p)]
    step = F.lit(p.step_ms)
    spread = near.select("labels", "lkey", F.explode(F.array(*parts)).alias("x")).where("x is not null")
    spread = spread.select("labels", "lkey", "x.use", "x.v", "x.check", (F.ceil(F.col("x.lo") / step) * step).cast("long").alias("lo"),
                           (F.floor(F.col("x.hi") / step) * step).cast("long").alias("hi")).where("lo <= hi")
    use, side = F.col("use"), _case(F.col("use"), {i: u.side for i, u in enumerate(uses)})
    grouped = {b: [i for i, u in enumerate(uses) if u.by == b] for b in {u.by for u in uses} - {None}}
    labels, key = F.col("labels"), F.col("lkey")
    for by, members in sorted(grouped.items()):
        pairs = [x for b in by for x in (F.lit(b), label("labels", b))]
        kept = drop_empty(F.create_map(*pairs)) if by else F.create_map().cast(ts.EMPTY_LABELS)
        labels = F.when(use.isin(members), kept).otherwise(labels)
        key = F.when(use.isin(members), labels_key(kept)).otherwise(key)
    steps = spread.select(_case(use, {i: u.rule for i, u in enumerate(uses)}).alias("rule"), side.alias("side"), "v", "check",
                          F.map_entries(labels).alias("entries"), key.alias("lkey"),
                          F.explode(F.sequence("lo", "hi", step)).alias("t"))

    def on(s, c):
        return F.when(F.col("side") == s, F.col(c))
    added = steps.groupBy("rule", "t", "lkey", "entries").agg(
        F.sum(on(0, "v")).alias("left"), F.count(on(0, "v")).alias("n"), F.sum(on(1, "v")).alias("right"),
        F.sum("check").alias("check"))
    name = F.col("rule")
    value = _case(name, {r.name: r.fn for r in rules})
    left, right = _added(rules, 0, "left", p), _added(rules, 1, "right", p)
    value = (F.when(value == "ratio", ts.ieee_divide(left, right))
             .when(value == "count", F.col("n").cast("double")).otherwise(left))
    deltas = [r.name for r in rules if isinstance(r.uses[0].leaf, Delta)]
    whole = F.col("n") > 0
    whole = whole & (F.col("right").isNotNull() | ~name.isin([r.name for r in rules if r.fn == "ratio"] or [""]))
    whole = whole & ((F.col("check") != 0) | ~name.isin(deltas or [""]))
    found = added.where(whole).withColumn("value", value)
    for op in sorted({r.keep[0] for r in rules if r.keep}):
        limits = {r.name: float(r.keep[1]) for r in rules if r.keep and r.keep[0] == op}
        found = found.where(~name.isin(list(limits)) | ts.compare_values(F.col("value"), op, _case(name, limits)))
    return found.select("rule", "t", F.map_from_entries("entries").alias("labels"), "lkey", "value")
