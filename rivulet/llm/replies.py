"""Chat formatting of reply trees.

Messages form trees: each answers another one of its conversation, or none.  A conversation is one path
from a root to a leaf.

* ``reply_tree`` and ``turn_chain`` number the messages and find each one's parent by a self-join.
* ``climbs`` joins the parent table with itself again and again: table k holds every message's ancestor
  2^k replies above and the scores passed on the way, so that the number of joins is logarithmic in
  the deepest reply.
* ``branches`` walks all leaves to their roots by these tables, which gives each path's length and score,
  and ranks the paths of a tree; the best ``keep`` are chosen (None: all).
* ``turns`` unfolds the chosen paths only, one row per message of a path.
* ``formatted`` writes a path as one conversation: one row, or for long paths one row per
  ``SEGMENT_TURNS`` turns, which are to be read one after the other.  So neither a long thread nor a
  popular message is gathered in one task.

The template marks each turn by its role.  Control strings inside texts and roles are escaped by a
backslash after their first character (one more, where there are some already), which is reversible;
in roles a backslash and a line break are written as ``\\\\`` and ``\\n`` as well.  The loss mask is a list of
spans in code points, one for the text of each assistant turn, without the marks.

Defined results: a null role or text is empty; a null conversation id is a conversation of its own; a
parent that doesn't exist makes a root; on a cycle of replies the message numbered first is the root;
of rows that share a message id the first in the order of parent, role, text and score counts; a null score
is 0; equal scores rank by the order of leaves; texts of any length are formatted whole; an empty table gives
an empty result; further columns aren't read.  Rows by turn are ordered by turn (null first), then role and
a hash of the text, and repeated rows are turns of their own.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import let_workers_import, scratch

START, STOP = "<|im_start|>", "<|im_end|>"
#: Strings that a tokenizer may take for control tokens.
CONTROL = (START, STOP, "<|endoftext|>", "<s>", "</s>", "<unk>", "<pad>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
ASSISTANT = "assistant"
#: Turns in one row of a formatted conversation.
SEGMENT_TURNS = 256

_AFTER = "|".join(f"{re.escape(c[0])}(\\\\*)(?={re.escape(c[1:])})" for c in CONTROL)
_CONTROL = re.compile(_AFTER)
_ESCAPED = re.compile(_AFTER.replace("(\\\\*)", "\\\\(\\\\*)"))


# --- template ------------------------------------------------------------------------

def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[0][0] + m[0][2:], text)


def _role_line(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def _role(line: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(line))


def render(turns: list[tuple[str | None, str | None]]) -> tuple[str, list[tuple[int, int]]]:
    """(text, spans under the loss mask) of consecutive turns (role, text)."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body, tail = f"{START}{_role_line(role or '')}\n", escape(text or ""), f"{STOP}\n"
        if role == ASSISTANT:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, tail]
        at += len(head) + len(body) + len(tail)
    return "".join(parts), spans


def parse(text: str) -> Iterator[tuple[str, str]]:
    """The turns (role, text) of a formatted text."""
    at = 0
    while at < len(text):
        line, stop = text.index("\n", at), text.index(STOP, at)
        yield _role(text[at + len(START):line]), unescape(text[line + 1:stop])
        at = stop + len(STOP) + 1


# --- trees -----------------------------------------------------------------------------

def _numbered(rows: DataFrame, order: list) -> DataFrame:
    """Rows written in the order of the given columns, with a dense number ``node`` over all of them."""
    held = scratch(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(
        "part", F.spark_partition_id()).withColumn("row", F.monotonically_increasing_id()), "replies-rows")
    sizes = held.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("first"))
    w = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)           # a row per partition
    starts = sizes.select("part", (F.coalesce(F.sum("n").over(w), F.lit(0)) - F.col("first")).alias("shift"))
    return held.join(F.broadcast(starts), "part").withColumn("node", F.col("row") + F.col("shift")).drop("part", "row", "shift")


def turn_chain(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
               score: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Messages and links of conversations given as rows by turn: each turn answers the one before."""
    value = F.col(score).cast("double") if score else F.lit(None).cast("double")
    rows = rows.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.col(role).alias("role"),
                       F.col(text).alias("text"), value.alias("score"), F.xxhash64(text).alias("mix"))
    # the hash in the range keys deals out a turn that very many rows share
    ordered = [F.col(c).asc_nulls_first() for c in ("conv", "turn", "role", "mix")]
    messages = _numbered(rows, ordered).drop("turn", "mix")
    here = messages.select("node", "conv", "score")
    above = messages.select((F.col("node") + 1).alias("next"), F.col("conv").alias("of"))
    linked = here.join(above, here.node == above.next, "left")
    parent = F.when(F.col("next").isNotNull() & F.col("conv").eqNullSafe(F.col("of")), F.col("node") - 1)
    return messages, linked.select("node", parent.alias("parent"), F.coalesce("score", F.lit(0.0)).alias("score"))


def reply_tree(rows: DataFrame, conv: str = "conv_id", message: str = "message_id", parent: str = "parent_id",
               role: str = "role", text: str = "text", score: str = "score") -> tuple[DataFrame, DataFrame]:
    """Messages and links of conversations whose rows name the message they answer."""
    rows = rows.select(F.col(conv).alias("conv"), F.col(message).alias("id"), F.col(parent).alias("up"),
                       F.col(role).alias("role"), F.col(text).alias("text"), F.col(score).cast("double").alias("score"))
    first = F.min(F.struct("up", "role", "text", "score")).alias("m")
    rows = rows.groupBy("conv", "id").agg(first).select("conv", "id", "m.*")
    messages = _numbered(rows, [F.col(c).asc_nulls_first() for c in ("conv", "id")])
    above = messages.select(F.col("conv").alias("of"), F.col("id").alias("is"), F.col("node").alias("parent"))
    linked = messages.select("node", "conv", "up", "score").join(
        above, F.col("conv").eqNullSafe(F.col("of")) & (F.col("up") == F.col("is")), "left")
    return messages.drop("id", "up"), linked.select("node", "parent", F.coalesce("score", F.lit(0.0)).alias("score"))


def _twice(table: DataFrame, *more) -> DataFrame:
    """Every message's ancestor twice as far above: a table of steps joined with itself."""
    a, b = table.alias("a"), table.alias("b")
    return a.join(b, F.col("a.up") == F.col("b.node")).select(F.col("a.node"), F.col("b.up"), *more)


def climbs(links: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(links, tables of 2^k steps: node, up, gain).  ``gain`` adds the scores from node to below ``up``."""
    links = scratch(links, "replies-links")
    step = links.filter("parent is not null").select("node", F.col("parent").alias("up"), F.col("score").alias("gain"))
    tables, most = [], step.count()
    while True:
        step = scratch(step, "replies-climb")
        if step.isEmpty():
            return links, tables
        tables.append(step)
        if 1 << len(tables) > 2 * most:                          # further above than there are messages
            return climbs(_without_cycles(links, step, len(tables)))
        step = _twice(step, (F.col("a.gain") + F.col("b.gain")).alias("gain"))


def _without_cycles(links: DataFrame, endless: DataFrame, rounds: int) -> DataFrame:
    """The least message of every cycle loses its parent: the one whose least ancestor is itself."""
    step = (links.join(endless.select("node"), "node", "left_semi")
            .select("node", F.col("parent").alias("up"), F.col("parent").alias("low")))
    for _ in range(rounds):
        step = scratch(_twice(step, F.least("a.low", "b.low").alias("low")), "replies-cycle")
    heads = step.filter("low = node").select(F.col("node").alias("least"))
    return (links.join(heads, links.node == heads.least, "left")
            .select("node", F.when(F.col("least").isNull(), F.col("parent")).alias("parent"), "score"))


def branches(links: DataFrame, tables: list[DataFrame], keep: int | None = 1) -> DataFrame:
    """(leaf, root, last, score, rank): chosen paths; ``last`` is the position of the leaf, the root's is 0."""
    answered = links.select(F.col("parent").alias("node")).filter("node is not null").distinct()
    at = links.join(answered, "node", "left_anti").select(
        F.col("node").alias("leaf"), F.col("node").alias("cur"), F.lit(0.0).alias("score"), F.lit(0).cast("long").alias("last"))
    for k in reversed(range(len(tables))):
        t = tables[k]
        at = at.join(t, at.cur == t.node, "left").select(
            "leaf", F.coalesce("up", "cur").alias("cur"), (F.col("score") + F.coalesce("gain", F.lit(0.0))).alias("score"),
            (F.col("last") + F.when(F.col("up").isNotNull(), 1 << k).otherwise(0)).alias("last"))
    top = links.select(F.col("node").alias("root"), F.col("score").alias("own"))
    paths = at.join(top, at.cur == top.root).select("leaf", "root", "last", (F.col("score") + F.col("own")).alias("score"))
    best = F.row_number().over(Window.partitionBy("root").orderBy(F.col("score").desc(), "leaf"))
    if keep is None:
        return paths.withColumn("rank", best)
    return paths.withColumn("rank", best).filter(F.col("rank") <= keep)          # cut before the shuffle


def turns(messages: DataFrame, chosen: DataFrame, tables: list[DataFrame]) -> DataFrame:
    """(conv, leaf, rank, score, last, pos, role, text): every message of every chosen path.

    A row per message so far; the messages 2^k steps above all of them are added, k falling, so that
    every distance from the leaf is reached once.
    """
    at = scratch(chosen, "replies-paths").select("leaf", "rank", "score", "last", F.col("leaf").alias("cur"), F.col("last").alias("pos"))
    for k in reversed(range(len(tables))):
        t = tables[k].select("node", "up")
        both = F.array(F.struct("cur", "pos"), F.when(F.col("up").isNotNull(), F.struct(
            F.col("up").alias("cur"), (F.col("pos") - (1 << k)).alias("pos"))))
        at = (at.join(t, at.cur == t.node, "left").select("leaf", "rank", "score", "last", F.explode(both).alias("x"))
              .filter("x is not null").select("leaf", "rank", "score", "last", "x.cur", "x.pos"))
    at = scratch(at, "replies-turns")
    texts = messages.select("node", "conv", "role", "text")
    return at.join(texts, at.cur == texts.node).select("conv", "leaf", "rank", "score", "last", "pos", "role", "text")


# --- conversations -----------------------------------------------------------------------

def formatted(rows: DataFrame) -> DataFrame:
    """Formatted conversations of ``turns`` rows: conv, leaf, rank, score, segment, segments, text, loss."""
    let_workers_import(rows.sparkSession)
    kind = rows.schema["conv"].dataType.simpleString()
    segment = F.floor(F.col("pos") / SEGMENT_TURNS)
    dealt = (rows.withColumn("segment", segment).repartition("leaf", "segment").sortWithinPartitions("leaf", "pos")
             .select("conv", "leaf", "rank", "score", "last", "segment", "role", "text"))
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def write(batches):
        held, of = [], None

        def row(facts, conv):
            text, spans = render(held)
            leaf, rank, score, last, seg = facts
            return pa.RecordBatch.from_arrays(
                [conv, pa.array([leaf]), pa.array([rank], pa.int32()), pa.array([score]), pa.array([seg]),
                 pa.array([last // SEGMENT_TURNS + 1]), pa.array([text]),
                 pa.array([[{"start": a, "end": b} for a, b in spans]], span)],
                ["conv", "leaf", "rank", "score", "segment", "segments", "text", "loss"])
        for b in batches:
            facts = list(zip(*[b.column(i).to_pylist() for i in range(1, 6)]))
            said = zip(b.column(6).to_pylist(), b.column(7).to_pylist())
            done = []
            for i, (f, turn) in enumerate(zip(facts, said)):
                if of is None or (f[0], f[4]) != (of[0], of[4]):
                    if of is not None:
                        done.append(row(of, conv))
                    held, of, conv = [], f, b.column(0).slice(i, 1)
                held.append(turn)
            if done:
                yield pa.Table.from_batches(done).combine_chunks().to_batches()[0]
        if of is not None:
            yield row(of, conv)
    return dealt.mapInArrow(write, f"conv {kind}, leaf long, rank int, score double, segment long, segments long, text string, "
                                   "loss array<struct<start:long,end:long>>")


def read_back(conversations: DataFrame) -> DataFrame:
    """What formatted conversations hold: conv, leaf, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    Read from the text and its loss mask alone.  Conversations of one row are read where they are; those of several
    rows are sorted and read one row after the other, the digests being all that is kept.
    """
    let_workers_import(conversations.sparkSession)
    kind = conversations.schema["conv"].dataType.simpleString()
    names = ["conv", "leaf", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def digest(batches):
        of, state, conv = None, None, None

        def row():
            return [conv, pa.array([of]), pa.array([state[0]]), pa.array([state[1].hexdigest()]), pa.array([state[2]]),
                    pa.array([state[3].hexdigest()]), pa.array([state[4]])]
        for b in batches:
            done = []
            for i, (leaf, text, loss) in enumerate(zip(b.column(1).to_pylist(), b.column(2), b.column(3))):
                if leaf != of:
                    if of is not None:
                        done.append(pa.RecordBatch.from_arrays(row(), names))
                    of, state, conv = leaf, [0, hashlib.sha256(), 0, hashlib.sha256(), 0], b.column(0).slice(i, 1)
                text = text.as_py()
                for role, said in parse(text):
                    state[0] += 1
                    state[1].update(f"{role}\n{said}\n".encode())
                for span in loss.as_py():
                    said = unescape(text[span["start"]:span["end"]])
                    state[2] += len(said)
                    state[3].update(said.encode())
                state[4] += len(text)
            if done:
                yield pa.Table.from_batches(done).combine_chunks().to_batches()[0]
        if of is not None:
            yield pa.RecordBatch.from_arrays(row(), names)
    schema = f"conv {kind}, leaf long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    columns = ["conv", "leaf", "text", "loss"]
    whole = conversations.filter("segments = 1").select(*columns)
    parts = conversations.filter("segments > 1").repartition("leaf").sortWithinPartitions("leaf", "segment").select(*columns)
    return whole.mapInArrow(digest, schema).union(parts.mapInArrow(digest, schema))


def conversations(messages: DataFrame, links: DataFrame, keep: int | None = 1) -> DataFrame:
    """The ``keep`` best paths of every tree, each formatted as one conversation."""
    links, tables = climbs(links)
    return formatted(turns(messages, branches(links, tables, keep), tables))
