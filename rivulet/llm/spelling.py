"""Spelling variant grouping by a relational trie frontier.

Every word of the vocabulary is a path in a trie; the trie is a table.  A *node* is a prefix
(its 64-bit hash), an *edge* a row (node, character, character after it), and the end mark
``$`` is the last edge of a word.  Two words are near if they differ by exactly one inserted,
deleted or replaced code point.  Pairs are found by joining a frontier of states
(word, position, node, edits) with the edge table, level by level:

* A word's states without an edit lie on its own path, so their nodes are known.  One edit lies
  either in the later half of a word or, read backwards, in the later half of the
  reversed word: each word enters two tries and branches in their lower halves only, where
  nodes have few edges.
* First level: a state branches where an edge leaves its node that replaces the next
  character (by a greater one: the lesser word finds the pair) or skips it (the
  longer word finds the pair; of a run of equal characters the last is skipped).  The join
  key holds the character that must follow the edit, so a branch that dies at once is never made.
* Further levels: a state with one edit must follow edges that spell the rest of its word.
  A level takes 2, 4, 8, ... characters at once (the node below is looked up), so that the number
  of levels is logarithmic in the longest word.
* A state that has taken the end mark is terminal.  Its text joins the vocabulary, which settles
  hash collisions, and the pair becomes a link of both words.

Each level is a join of narrow rows spread by node and position; nothing is gathered per
word or node, and a popular prefix is one key per following character.

Defined results: null and empty texts hold no words; a null id counts as empty text before the
colon of the hash; a text of any length is scanned whole; repeated rows count again; an empty
table gives an empty result; ties of counts go to the smallest word in code-point order; further
columns aren't read.  A word of any length is a path like any other, but its states carry its text, so
work grows with the square of a word's length.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let_workers_import, scratch

LEAST_LENGTH = 7
LEAST_COUNT = 2
RATIO = 10
#: One run in so many loses a code point.
DAMAGE = 31
#: Distinct words that a task gathers before it hands counts on.
HELD_WORDS = 400_000

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_COUNTS = pa.schema([("word", pa.string()), ("n", pa.int64())])
END = "$"


def words_of(doc_id, text: str, least: int = LEAST_LENGTH) -> list[str]:
    """The words of one text: runs of letters, some of them with a code point deleted."""
    runs = re.findall(f"[a-zÀ-ÿ]{{{least},}}", text.encode("utf-8").translate(_LOWER).decode("utf-8"))
    seed = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    hashes = np.fromiter(map(zlib.crc32, map(str.encode, runs), repeat(seed)), np.int64, len(runs))
    for i in np.flatnonzero(hashes % DAMAGE == 0).tolist():
        k = int(hashes[i]) % len(runs[i])
        runs[i] = runs[i][:k] + runs[i][k + 1:]
    return runs


def vocabulary(docs: DataFrame, least: int = LEAST_LENGTH, count: int = LEAST_COUNT) -> DataFrame:
    """(word, n): words of at least ``least`` code points that occur ``count`` times or more."""
    let_workers_import(docs.sparkSession)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())],
                                             schema=_COUNTS)
            held.clear()
            return out
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1)):
                if text.is_valid:
                    held.update(words_of(doc_id, text.as_py(), least))
                    if len(held) >= HELD_WORDS:
                        yield flush()
        yield flush()

    found = docs.select("doc_id", "text").mapInArrow(gather, "word string, n long")
    return (found.filter(F.char_length("word") >= least).groupBy("word").agg(F.sum("n").alias("n"))
            .filter(F.col("n") >= count))


def _node(way: Column, prefix: Column, after: Column | None = None) -> Column:
    """Key of a trie node, or of a node and the character that must follow the one after it."""
    return F.xxhash64(way, prefix) if after is None else F.xxhash64(way, prefix, after)


def _cut(text: str, start: Column, length: Column | int) -> Column:
    return F.substring(F.col(text), start, F.lit(length) if isinstance(length, int) else length)


def _paths(words: DataFrame) -> DataFrame:
    """(way, s, at): each word with its end mark, forwards and backwards, and where its lower half begins.

    Rows are dealt by ranges of the text, so that words that share a prefix share a task and their
    common nodes are made distinct before the shuffle.
    """
    length = F.char_length("word")
    half = F.floor(length / 2).cast("int")
    both = words.select(F.explode(F.array(
        F.struct(F.lit(0).alias("way"), F.concat("word", F.lit(END)).alias("s"), half.alias("at")),
        F.struct(F.lit(1).alias("way"), F.concat(F.reverse("word"), F.lit(END)).alias("s"),
                 (length - half).alias("at")))).alias("x")).select("x.*")
    return both.repartitionByRange("way", "s")


def _branches(paths: DataFrame) -> DataFrame:
    """(way, s, cand, depth): states after the first level, with one edit and ``depth`` characters matched."""
    p, way = F.col("p"), F.col("way")
    last = F.char_length("s") - 1                                # position of the end mark
    steps = paths.select("way", "s", F.explode(F.sequence("at", last)).alias("p"))
    prefix, here, after, third = (_cut("s", F.lit(1), p), _cut("s", p + 1, 1), _cut("s", p + 2, 1), _cut("s", p + 3, 1))
    edges = steps.select(_node(way, prefix, after).alias("key"), here.alias("c")).distinct()
    twin = F.when(way == 0, after).otherwise(_cut("s", p, 1))   # of equal characters, the last of the word is skipped
    states = steps.filter(p < last).select("way", "s", "p", F.explode(F.array(
        F.struct(F.lit(True).alias("swap"), _node(way, prefix, after).alias("want")),
        F.struct(F.lit(False).alias("swap"), F.when(here != twin, _node(way, prefix, third)).alias("want")))).alias("k"))
    states = states.select("way", "s", "p", "k.swap", "k.want").filter("want is not null")
    swap, c = F.col("swap"), F.col("c")
    taken = states.join(edges, states.want == edges.key).filter(
        F.when(swap, (c > here) & (c != END)).otherwise(c == after))
    rest = F.substring(F.col("s"), p + 2, F.char_length("s"))
    cand = F.when(swap, F.concat(prefix, c, rest)).otherwise(F.concat(prefix, rest))
    return taken.select("way", "s", cand.alias("cand"), F.least(p + 2, F.char_length(cand)).alias("depth"))


def near(words: DataFrame) -> DataFrame:
    """(a, na, b, nb): every pair of near words of the vocabulary ``words`` (word unique, n), once."""
    paths = scratch(_paths(words), "spelling-paths")
    steps = paths.select("way", "s", F.explode(F.sequence(F.col("at") + 1, F.char_length("s"))).alias("d"))
    nodes = scratch(steps.select(_node(F.col("way"), _cut("s", F.lit(1), F.col("d"))).alias("node")).distinct(),
                    "spelling-nodes")
    frontier, done, stride = scratch(_branches(paths), "spelling-frontier"), [], 2
    size = F.char_length("cand")
    while True:
        done.append(frontier.filter(F.col("depth") == size).select("way", "s", "cand"))
        open_ = frontier.filter(F.col("depth") < size)
        if open_.isEmpty():
            break
        ahead = open_.withColumn("depth", F.least(F.col("depth") + stride, size))
        ahead = ahead.withColumn("next", _node(F.col("way"), _cut("cand", F.lit(1), F.col("depth"))))
        frontier = scratch(ahead.join(nodes, ahead.next == nodes.node, "left_semi").drop("next"), "spelling-frontier")
        stride *= 2
    found = done[0]
    for d in done[1:]:
        found = found.union(d)

    def word(c):
        text = F.substring(F.col(c), F.lit(1), F.char_length(c) - 1)
        return F.when(F.col("way") == 0, text).otherwise(F.reverse(text)).alias(c)
    found = found.select(word("s"), word("cand"))
    left = words.select(F.col("word").alias("a"), F.col("n").alias("na"))
    right = words.select(F.col("word").alias("b"), F.col("n").alias("nb"))
    return (found.join(right, found.cand == right.b).join(left, F.col("s") == F.col("a"))
            .select("a", "na", "b", "nb"))


def forms(words: DataFrame, pairs: DataFrame, ratio: int = RATIO) -> DataFrame:
    """(word, form, n, n_near, form_n): the most frequent near word, if it is ``ratio`` times as frequent."""
    both = pairs.select(F.explode(F.array(
        F.struct(F.col("a").alias("word"), F.col("b").alias("other"), F.col("nb").alias("m")),
        F.struct(F.col("b").alias("word"), F.col("a").alias("other"), F.col("na").alias("m")))).alias("x")).select("x.*")
    best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"),
                                    F.min(F.struct((-F.col("m")).alias("m"), "other")).alias("top"))
    top, enough = F.col("top"), -F.col("top.m") >= ratio * F.col("n")
    return (words.join(best, "word", "left")
            .select("word", F.when(enough, top["other"]).alias("form"), "n",
                    F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(enough, -top["m"]).alias("form_n")))


def roots(table: DataFrame) -> DataFrame:
    """(word, root) of every word with a form: the last word reached by following forms.

    A form is more frequent than its word, so there is no cycle; pointers are doubled, so that the
    number of rounds is logarithmic in the longest chain.
    """
    links = scratch(table.filter("form is not null").select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        onward = links.select(F.col("word").alias("via"), F.col("root").alias("last"))
        joined = links.join(onward, links.root == onward.via, "left")
        links = scratch(joined.select("word", F.coalesce("last", "root").alias("root"),
                                      F.col("last").isNotNull().alias("moved")), "spelling-roots")
        moved, links = links.filter("moved"), links.select("word", "root")
        if moved.isEmpty():
            return links


def variants(docs: DataFrame, least: int = LEAST_LENGTH, count: int = LEAST_COUNT, ratio: int = RATIO) -> DataFrame:
    """Per word of ``docs`` (doc_id, text): word, form, root, n, n_near, form_n."""
    words = scratch(vocabulary(docs, least, count), "spelling-words")
    table = scratch(forms(words, near(words), ratio), "spelling-forms")
    last = roots(table).withColumnRenamed("word", "of")
    return (table.join(last, table.word == last.of, "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"))
