"""Metric-name and label rewriting over raw readings and scrape targets.

Two rule systems are covered:

* **bean rewrite rules** -- an ordered list of ``pattern -> name, labels,
  type, value`` applied to managed-bean reading strings of the form
  ``domain<k=v, ...><keys>attribute: value``; the first rule whose pattern
  occurs in the string wins (a pattern is matched as ``^.*(?:p).*$``);
  readings no rule matches are dropped;
* **relabel steps** -- ``keep``, ``drop``, ``replace`` (including copies and
  constants) and ``labelmap`` applied in order to a label map, with fully
  anchored regexes.

Rules are compiled on the driver into one ``coalesce``/``CASE`` expression
per output column, so a whole rule list is evaluated in a single projection
inside whole-stage codegen -- no UDF, no per-rule pass over the data.
Templates (``$1``, ``${1}``, ``0.$6``) become ``concat`` of literals and
``regexp_extract`` group lookups.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import labels_key, map_last_wins


@dataclass(frozen=True)
class BeanRule:
    pattern: str
    name: str | None = None
    labels: dict = field(default_factory=dict)
    type: str | None = None
    value: str | None = None

    @property
    def dynamic(self) -> bool:
        """Does the rule capture a label *name* from the reading?"""
        return any("$" in name for name in self.labels)

    @property
    def reaches_value(self) -> bool:
        """Can a group of the pattern reach into the value text behind the bean?"""
        return re.search(r"\(\.[+*]\)$|: ?\(", self.pattern) is not None

    @property
    def catch_all(self) -> bool:
        """Does the rule take every reading that reaches it?"""
        return self.pattern == ".*"

    @property
    def full(self) -> str:
        return f"^.*(?:{self.pattern}).*$"


def template_pieces(template: str, flavor: str = "java") -> list:
    """Split a replacement template into literal strings and group numbers.

    ``java``: ``$<digits>`` is a group reference.  ``go``: ``${name}`` or
    ``$name`` with the longest ``[A-Za-z0-9_]`` name; a non-numeric name
    (there are no named groups) expands to the empty string.
    """
    pat = r"\$\{(\w+)\}|\$(\d+)" if flavor == "java" else r"\$\{(\w+)\}|\$(\w+)"
    out, pos = [], 0
    for m in re.finditer(pat, template):
        if m.start() > pos:
            out.append(template[pos:m.start()])
        ref = m.group(1) or m.group(2)
        out.append(int(ref) if ref.isdigit() else "")
        pos = m.end()
    if pos < len(template):
        out.append(template[pos:])
    return [p for p in out if p != ""]


def expand(src: Column, regex: str, template: str, flavor: str = "java") -> Column:
    """The template expanded with the groups of ``regex`` matched on ``src``."""
    parts = [F.lit(p) if isinstance(p, str) else F.regexp_extract(src, regex, p)
             for p in template_pieces(template, flavor)]
    return F.concat(*parts) if parts else F.lit("")


def safe_name(c: Column) -> Column:
    """Metric/label name sanitising: runs of characters outside
    ``[A-Za-z0-9:]`` (underscores included) become one ``_``; a leading digit
    gets a ``_`` prefix.  (Written to reference its input once, so it never
    duplicates a large input expression.)"""
    return F.regexp_replace(F.regexp_replace(c, "[^a-zA-Z0-9:]+", "_"), "^([0-9])", "_$1")


_BEAN = r"^([^<]*)<([^>]*)><([^>]*)>([^:]*)"
_ID, _PAIR, _KV = "\x03", "\x01", "\x02"   # delimiters that never occur in readings


def _default_rest(bean: Column) -> Column:
    props = F.regexp_extract(bean, _BEAN, 2)
    return F.regexp_extract(props, r"^[^,]*,\s*(.*)$", 1)


def default_name(bean: Column) -> tuple[Column, Column]:
    """Name and labels for a rule without ``name``: ``domain_firstvalue_attr``
    with the remaining bean properties as labels."""
    domain = F.regexp_extract(bean, _BEAN, 1)
    props = F.regexp_extract(bean, _BEAN, 2)
    attr = F.regexp_extract(bean, _BEAN, 4)
    first = F.regexp_extract(props, r"^[^=]*=([^,]*)", 1)
    rest = F.regexp_extract(props, r"^[^,]*,\s*(.*)$", 1)
    name = F.concat_ws("_", domain, first, attr)
    labels = F.when(rest == "", F.create_map().cast("map<string,string>")).otherwise(
        F.str_to_map(F.regexp_replace(rest, r",\s+", ","), F.lit(","), F.lit("=")))
    return name, labels


def _java_template(template: str) -> str:
    """Escape a rule template for Java's replacement syntax (only ``$n`` is
    special in the rule files; a backslash is taken literally)."""
    return template.replace("\\", "\\\\")


_META = set(".^$*+?{}[]()|\\")


def required_literals(pattern: str, min_len: int = 4) -> list[str]:
    """Literal runs that every match of ``pattern`` must contain.

    Only text outside groups and classes counts; a character made optional by
    ``?``, ``*`` or ``{`` is dropped, and a top-level ``|`` means nothing is
    required.  Used as a cheap ``contains`` pre-check before the regex.
    """
    runs, cur, depth, i = [], "", 0, 0
    while i < len(pattern):
        c = pattern[i]
        nxt = pattern[i + 1] if i + 1 < len(pattern) else ""
        if c == "\\":
            esc = pattern[i + 1:i + 2]
            lit = esc if esc and not esc.isalnum() else None
            i += 2
            if depth == 0 and lit is not None and (pattern[i:i + 1] not in ("?", "*", "{")):
                cur += lit
            else:
                runs.append(cur); cur = ""
            continue
        if c == "(":
            depth += 1; runs.append(cur); cur = ""
        elif c == ")":
            depth -= 1
        elif c == "[":
            j = pattern.index("]", i + 1)
            i = j
            runs.append(cur); cur = ""
        elif c == "|" and depth == 0:
            return []
        elif depth == 0:
            if c in _META:
                runs.append(cur); cur = ""
            elif nxt in ("?", "*", "{"):
                runs.append(cur); cur = ""
            else:
                cur += c
        i += 1
    runs.append(cur)
    return [r for r in runs if len(r) >= min_len]


def required_count(pattern: str, ch: str = "=") -> int:
    """How many ``ch`` characters every match must contain: occurrences
    outside groups and classes that no quantifier makes optional (a top-level
    ``|`` means none)."""
    n, depth, i = 0, 0, 0
    while i < len(pattern):
        c = pattern[i]
        nxt = pattern[i + 1:i + 2]
        if c == "\\":
            i += 2
            continue
        if c == "(":
            depth += 1
        elif c == ")":
            depth -= 1
        elif c == "[":
            i = pattern.index("]", i + 1)
        elif c == "|" and depth == 0:
            return 0
        elif depth == 0 and c == ch and nxt not in ("?", "*", "{"):
            n += 1
        i += 1
    return n


def _eq_count(bean: Column) -> Column:
    return F.length(bean) - F.length(F.replace(bean, F.lit("="), F.lit("")))


def _hit(bean: Column, r: BeanRule) -> Column:
    """Does the rule's pattern occur in the reading?  Cheap necessary
    conditions first -- its required literals (``contains`` is a byte search)
    and its required number of ``=`` -- the regex only when they pass."""
    lits = sorted(required_literals(r.pattern), key=len, reverse=True)[:2]
    cond = None
    for l in lits:
        c = bean.contains(l)
        cond = c if cond is None else cond & c
    k = required_count(r.pattern, "=")
    if k > 2:
        c = _eq_count(bean) >= F.lit(k)
        cond = c if cond is None else cond & c
    rx = bean.rlike(r.pattern)
    return rx if cond is None else cond & rx


#: Two values that stand in for a reading's value when a bean is rewritten by itself.
_STAND_INS = ("0", "1.5")
#: Characters without which a value text can't be taken for a part of the bean.
_BEAN_MARKS = "<>=,:\x01\x02\x03"


def apply_bean_rules(readings: DataFrame, rules_by_key: dict, key_col: str = "component",
                     bean_col: str = "bean", value_col: str = "value") -> DataFrame:
    """Rewrite readings into ``metric, labels, lkey, type, value, rule``.

    ``rules_by_key`` maps a value of ``key_col`` (the component) to its
    ordered rule list; the first rule whose pattern occurs in the reading wins
    (``rule`` is its index in that list) and unmatched readings are dropped.

    Which rule wins depends on the bean and not on its value (the rule files mark their
    rules as cacheable by bean for that reason), and few distinct beans exist.  So the
    rules run over the distinct ``(component, bean)`` pairs, and the result is joined back
    by hash.  Every bean is rewritten with two stand-in values: where both give the same,
    that is the result for any value; where they differ (a rule whose last group reaches
    into the value text), the reading itself is expanded, by the winning rule alone.
    Readings whose value text could be mistaken for a part of the bean run through the
    whole list themselves.

    The list is one ``CASE`` over the component and then over the rules in order, whose
    winning branch expands *all* of that rule's templates with a single
    ``regexp_replace`` into one delimited string ``id \x03 name \x01 key \x02 value ...``.
    It stands above a shuffle in both places (distinct beans; odd readings), so its large code never
    shares a stage with the readings.  A ``Generate`` over a one-element array makes sure that an
    expansion is evaluated once, however many columns are taken from it.
    """
    flat = [(k, i, r) for k, rules in rules_by_key.items() for i, r in enumerate(rules)]
    bean = F.col(bean_col)
    # each step is expanded from a one-element array: computed once, for the columns and for the filters below
    ends = readings.select("*", F.explode(F.array(F.substring_index(bean, ">", -1))).alias("_tail"))        # attribute: value
    cut = F.instr("_tail", ": ")
    text = F.substring("_tail", cut + 2, F.length("_tail"))
    plain = (cut > 0) & (text != "") & (F.translate(text, _BEAN_MARKS, "") == text)
    marked = ends.select(*readings.columns, F.explode(F.array(F.when(F.coalesce(plain, F.lit(False)), F.substring(
        bean, F.lit(1), F.length(bean) - F.length("_tail") + cut - 1)))).alias("_bean"))

    beans = marked.where(F.col("_bean").isNotNull()).select(key_col, "_bean").distinct()
    tried = (beans.withColumn("_v", F.explode(F.array(*[F.lit(v) for v in _STAND_INS])))
             .withColumn("_t", F.concat("_bean", F.lit(": "), "_v"))
             .select(key_col, "_bean", _chain(F.col("_t"), F.col(key_col), rules_by_key).alias("_c")))
    # a result that no value changes is named, labelled and typed once per bean
    fixed = F.when(F.col("_low") == F.col("_high"), _parsed(F.col("_low"), flat)).alias("_x")
    known = (tried.groupBy(F.col(key_col).alias("_k"), F.col("_bean").alias("_b"))
             .agg(F.min("_c").alias("_low"), F.max("_c").alias("_high")).where(F.col("_low").isNotNull())
             .select("_k", "_b", F.split("_low", _ID)[0].cast("int").alias("_won"), F.explode(F.array(fixed)).alias("_x"))
             .select("_k", "_b", "_won", *[F.col(f"_x.{c}").alias(f"_{c}") for c in _RESULT]))
    joined = marked.join(known, (F.col(key_col) == F.col("_k")) & (F.col("_bean") == F.col("_b")))

    others = [c for c in readings.columns if c not in (bean_col, value_col)]
    # beans whose result holds the value text are expanded by the winning rule alone
    case = F.lit(None).cast("string")
    for gid, (_, _, r) in enumerate(flat):
        if r.reaches_value:
            case = F.when(F.col("_won") == gid, _expanded(bean, r, gid)).otherwise(case)
    made = F.when(F.col("_metric").isNull(), _parsed(case, flat)).alias("_y")
    usual = joined.select(*others, value_col, *[f"_{c}" for c in _RESULT], F.explode(F.array(made)).alias("_y")).select(
        *others, value_col, *[F.coalesce(f"_{c}", f"_y.{c}").alias(c) for c in _RESULT])
    # readings that are no plain bean and value run through the whole list themselves
    odd = marked.where(F.col("_bean").isNull()).repartition(key_col, bean_col)
    odd = odd.select(*others, value_col, F.explode(F.array(_chain(bean, F.col(key_col), rules_by_key))).alias("_c"))
    odd = odd.where(F.col("_c").isNotNull()).select(*others, value_col, F.explode(F.array(_parsed(F.col("_c"), flat))).alias("_y"))
    out = usual.unionByName(odd.select(*others, value_col, *[f"_y.{c}" for c in _RESULT]))
    return out.select(*others, "metric", "labels", "type", F.coalesce("const", F.col(value_col).cast("double")).alias("value"),
                      "rule", "lkey")


#: What the rules make of a reading.
_RESULT = ("metric", "labels", "type", "const", "rule", "lkey")


def _parsed(text: Column, flat: list) -> Column:
    """Struct of name, labels, type, constant value and rule index from an expanded text."""
    head = F.split(text, _ID)
    gid = head[0].cast("int")
    parts = F.split(head[1], _PAIR)
    kv = F.transform(F.slice(parts, F.lit(2), F.size(parts)), lambda x: F.split(x, _KV))
    # two properties whose names sanitise alike: the later one stays
    pairs = F.filter(F.transform(kv, lambda a: F.struct(safe_name(a[0]).alias("key"), a[1].alias("value"))),
                     lambda e: e["key"] != F.lit(""))

    def lookup(values, dtype):
        return F.element_at(F.array(*[F.lit(v).cast(dtype) for v in values]), gid + 1)
    labels = map_last_wins(pairs)
    return F.struct(
        safe_name(parts[0]).alias("metric"), labels.alias("labels"),
        lookup([r.type or "UNTYPED" for _, _, r in flat], "string").alias("type"),
        lookup([None if r.value is None else float(r.value) for _, _, r in flat], "double").alias("const"),
        lookup([i for _, i, _ in flat], "int").alias("rule"), labels_key(labels).alias("lkey"))


def _chain(text: Column, key: Column, rules_by_key: dict) -> Column:
    """The rule lists as one ``CASE``: the winner's expansion, NULL without one."""
    case, gid = None, 0
    for k, rules in rules_by_key.items():
        chain = None
        for r in rules:
            hit = _hit(text, r)             # finds p anywhere == full match of ^.*(?:p).*$
            out = _expanded(text, r, gid)
            chain = F.when(hit, out) if chain is None else chain.when(hit, out)
            gid += 1
        case = F.when(key == k, chain) if case is None else case.when(key == k, chain)
    return case


def _expanded(bean: Column, r: BeanRule, gid: int) -> Column:
    """``id \x03 name (\x01 key \x02 value)*`` for the winning rule."""
    if not r.name:
        name, rest = default_name(bean)[0], _default_rest(bean)
        pairs = F.regexp_replace(F.regexp_replace(rest, r",\s+", _PAIR), "=", _KV)
        return F.concat(F.lit(f"{gid}{_ID}"), name,
                        F.when(rest != "", F.concat(F.lit(_PAIR), pairs)).otherwise(F.lit("")))
    t = f"{gid}{_ID}" + r.name + "".join(_PAIR + k + _KV + v for k, v in r.labels.items())
    return F.regexp_replace(bean, r.full, _java_template(t))


# ---------------------------------------------------------------- relabeling

@dataclass(frozen=True)
class Relabel:
    action: str = "replace"                  # replace | keep | drop | labelmap
    source_labels: tuple = ()
    regex: str = "(.*)"
    target_label: str | None = None
    replacement: str = "$1"
    separator: str = ";"


def _joined(labels: Column, names: Sequence[str], sep: str) -> Column:
    if not names:
        return F.lit("")
    return F.concat_ws(sep, *[F.coalesce(F.element_at(labels, F.lit(n)), F.lit("")) for n in names])


def relabel(df: DataFrame, steps: Sequence[Relabel], labels_col: str = "labels") -> DataFrame:
    """Apply relabel steps in order to a label-map column (rows may be
    dropped by ``keep``/``drop``).  Each step is a column expression or a
    filter; the chain stays one projection/filter pipeline."""
    for st in steps:
        labels = F.col(labels_col)
        full = f"^(?:{st.regex})$"
        src = _joined(labels, st.source_labels, st.separator)
        if st.action == "keep":
            df = df.where(src.rlike(full))
        elif st.action == "drop":
            df = df.where(~src.rlike(full))
        elif st.action == "replace":
            val = expand(src, full, st.replacement, "go")
            rest = F.map_filter(labels, lambda k, _: k != F.lit(st.target_label))
            new = F.when(val == "", rest).otherwise(
                F.map_concat(rest, F.create_map(F.lit(st.target_label), val)))
            df = df.withColumn(labels_col, F.when(src.rlike(full), new).otherwise(labels))
        elif st.action == "labelmap":
            mapped = F.map_filter(labels, lambda k, _: k.rlike(full))
            # two names mapped to one target: the last in name order stays
            renamed = map_last_wins(F.transform(
                F.array_sort(F.map_entries(mapped)),
                lambda e: F.struct(expand(e["key"], full, st.replacement, "go").alias("key"), e["value"].alias("value"))))
            keep = F.map_filter(labels, lambda k, _: ~F.map_contains_key(renamed, k))
            df = df.withColumn(labels_col, F.map_concat(keep, renamed))
        else:
            raise ValueError(f"unsupported relabel action {st.action!r}")
    return df


def drop_meta(labels: Column) -> Column:
    """Remove ``__``-prefixed target metadata labels after relabeling."""
    return F.map_filter(labels, lambda k, _: ~k.startswith("__"))
