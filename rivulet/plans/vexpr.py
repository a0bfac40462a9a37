"""Vector expressions that build a Spark plan and the matching oracle SQL.

A rule expression such as ``sum by (env) (m{name="x"}) != 1`` is written as
``Cmp("!=", 1, Agg("sum", ["env"], Inst("m", [("name", "=", "x")])))``.  The
tree is plain Python data: ``df()`` composes the DataFrame operators of
:mod:`rivulet.operators.timeseries`, ``sql()`` the DuckDB oracle CTEs.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass

from ..functions.labels import all_match
from ..operators import timeseries as ts
from . import sqlgen as q


def _shared(samples, key, build):
    return samples.memo(key, build) if hasattr(samples, "memo") else build()


@dataclass(frozen=True)
class Params:
    step_ms: int
    lookback_ms: int
    range_scale: float = 1.0     # multiply written ranges (dense evaluation)

    def rng(self, range_ms: int) -> int:
        return int(range_ms * self.range_scale)


_ids = itertools.count()


def _name(prefix: str) -> str:
    return f"{prefix}{next(_ids)}"


class Node:
    def df(self, samples, p: Params):
        raise NotImplementedError

    def sql(self, ctes: list, p: Params) -> str:
        raise NotImplementedError


@dataclass(frozen=True)
class Inst(Node):
    metric: str
    matchers: tuple = ()

    def df(self, samples, p):
        # The per-series pick does not depend on the matchers (they are
        # constant within a series), so the metric's instant vector is built
        # once and shared by every expression selecting from it.
        vec = _shared(samples, ("instant", self.metric, p.step_ms, p.lookback_ms),
                      lambda: ts.instant(ts.select_series(samples, self.metric), p.step_ms, p.lookback_ms))
        return vec.where(all_match("labels", self.matchers))

    def sql(self, ctes, p):
        s, v = _name("sel"), _name("inst")
        ctes += [q.sel(s, self.metric, self.matchers), q.instant(v, s, p.step_ms, p.lookback_ms)]
        return v


@dataclass(frozen=True)
class Rate(Node):
    metric: str
    matchers: tuple = ()
    range_ms: int = 300_000

    def df(self, samples, p):
        vec = _shared(samples, ("rate", self.metric, p.rng(self.range_ms), p.step_ms),
                      lambda: ts.rate(ts.select_series(samples, self.metric), p.rng(self.range_ms), p.step_ms))
        return vec.where(all_match("labels", self.matchers))

    def sql(self, ctes, p):
        s, v = _name("sel"), _name("rate")
        ctes += [q.sel(s, self.metric, self.matchers),
                 q.increase(v, s, p.rng(self.range_ms), p.step_ms, True)]
        return v


@dataclass(frozen=True)
class Delta(Node):
    metric: str
    matchers: tuple = ()
    range_ms: int = 300_000

    def df(self, samples, p):
        vec = _shared(samples, ("delta", self.metric, p.rng(self.range_ms), p.step_ms),
                      lambda: ts.delta(ts.select_series(samples, self.metric), p.rng(self.range_ms), p.step_ms))
        return vec.where(all_match("labels", self.matchers))

    def sql(self, ctes, p):
        s, v = _name("sel"), _name("delta")
        ctes += [q.sel(s, self.metric, self.matchers), q.delta(v, s, p.rng(self.range_ms), p.step_ms)]
        return v


@dataclass(frozen=True)
class Agg(Node):
    fn: str
    by: tuple
    child: Node

    def df(self, samples, p):
        return ts.aggregate(self.child.df(samples, p), self.fn, self.by)

    def sql(self, ctes, p):
        c = self.child.sql(ctes, p)
        v = _name("agg")
        ctes.append(q.aggregate(v, c, self.fn, self.by))
        return v


@dataclass(frozen=True)
class Cmp(Node):
    op: str
    value: float
    child: Node

    def df(self, samples, p):
        return ts.compare(self.child.df(samples, p), self.op, self.value)

    def sql(self, ctes, p):
        c = self.child.sql(ctes, p)
        v = _name("cmp")
        op = "=" if self.op == "==" else ("<>" if self.op == "!=" else self.op)
        ctes.append(f"{v} AS (SELECT * FROM {c} WHERE value {op} {float(self.value)!r})")
        return v


@dataclass(frozen=True)
class Bin(Node):
    op: str
    left: Node
    right: Node

    def df(self, samples, p):
        return ts.binary(self.left.df(samples, p), self.right.df(samples, p), self.op)

    def sql(self, ctes, p):
        a, b = self.left.sql(ctes, p), self.right.sql(ctes, p)
        v = _name("bin")
        ctes.append(q.binary(v, a, b, self.op))
        return v
