"""Language-model scoring with Brown class-based bigrams.

A word belongs to one class; a text's probability is the product of class transitions
``P(class | previous class)`` and word emissions ``P(word | class)``.

* Word counts over all training documents are exact and distributed (counted in the
  tasks, summed by a shuffle).
* Every text is written once as numbers: a word of the *head* (the ``HEAD`` most frequent
  words, the bounded table that tasks hold) is its place in it, any other word its type.
* Classes come from exchange clustering in two steps.  The first is over *types*: the most
  frequent words, and for all other words their signature (last letters and closing mark), so
  that rare and unseen words also have a class; it moves one type at a time to the class that
  raises the likelihood most, over the bigrams of types of all training documents.  The second
  is over the vocabulary: for every other word of the head seen ``LEAST_SEEN`` times or more,
  Spark sums its neighbours' classes over all training documents, and the task that holds a
  word moves it to its best class given all others' classes.  A sweep over the vocabulary is
  undone if it doesn't raise the likelihood.
* Class transitions are exact counts over all training documents, interpolated with the class
  frequencies.  Emissions use absolute discounting; the discounted mass of a class is
  its probability of a word never seen in training.
* Scoring: words of the head are answered inside the task; the other words of a document are
  joined with the count table.  No word outside the head is frequent, so the join has no hot key.

Every text ends with an end token, a class of its own, which is also the context of
the first word.

Defined results: null and empty texts are the end token alone; without training
documents all counts are zero and the base score is 0; ties in frequency are broken
by the word; repeated rows are scored alike; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import RecentCache, crc_mod, scratch, small_batches, text_udf

CLASSES = 64
WORD_TYPES = 500
SIGNATURE_TYPES = 250
HEAD = 200_000
SWEEPS = 20
#: Sweeps over the vocabulary, and the least occurrences of a word that they move.
VOCABULARY_SWEEPS = 2
LEAST_SEEN = 3
#: Parts of the vocabulary whose neighbours are summed and moved together.
PARTS = 256
#: Distinct entries a task gathers before it hands them on.
FLUSH = 300_000
TRANSITION_PRIOR = 10.0

_CLOSING = re.compile(r"[^\w]+$")


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased."""
    return (text or "").encode("utf-8", "replace").lower().split()


def signature(word: str) -> str:
    """What a rare word's class depends on: its last two letters and the mark that closes it."""
    m = _CLOSING.search(word)
    core, mark = (word[:m.start()], m.group()[0]) if m else (word, "")
    if not core:
        return "@"
    if core[-1].isdigit():
        return "#" + mark
    return core[-2:] + "|" + mark


def count_words(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word, n) over all texts, summed inside the tasks first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def hand_on():
            return pa.RecordBatch.from_arrays(
                [pa.array([w.decode("utf-8", "replace") for w in seen], pa.string()),
                 pa.array(list(seen.values()), pa.int64())], ["word", "n"])
        seen: Counter = Counter()
        for b in batches:
            for t in b.column(0).to_pylist():
                seen.update(words_of(t))
                if len(seen) > FLUSH:
                    yield hand_on()
                    seen.clear()
        if seen:
            yield hand_on()
    return docs.select(text).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Types:
    """Word -> type number: 0 is the end, then frequent words, then signatures, then the rest."""

    def __init__(self, words: list[str], signatures: list[str]):
        self.words = {w.encode(): i for i, w in enumerate(words, 1)}
        self.signatures = {s: i for i, s in enumerate(signatures, 1 + len(words))}
        self.size = 2 + len(words) + len(signatures)
        self.rest = self.size - 1
        self.cache = RecentCache(self._type)

    def __reduce__(self):
        return Types._again, (self.words, self.signatures, self.size)

    @classmethod
    def _again(cls, words, signatures, size):
        self = cls.__new__(cls)
        self.words, self.signatures, self.size, self.rest = words, signatures, size, size - 1
        self.cache = RecentCache(self._type)
        return self

    def _type(self, word: bytes) -> int:
        known = self.words.get(word)
        if known is None:
            known = self.signatures.get(signature(word.decode("utf-8", "replace")), self.rest)
        return known


class Vocabulary:
    """Word -> number: its place in the head, or behind the head the type of any other word."""

    def __init__(self, types: Types, head: list[bytes]):
        self.types, self.place = types, {w: i for i, w in enumerate(head)}
        self.size = len(head) + types.size
        #: Type of each number.
        self.type_of = np.concatenate([np.fromiter(map(types._type, head), np.int64, len(head)), np.arange(types.size)])
        self._remember()

    def _remember(self) -> None:
        h = len(self.place)
        self.cache = RecentCache(lambda w: self.place[w] if w in self.place else h + self.types._type(w))

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "cache"}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._remember()

    def encode(self, text: str | None) -> tuple:
        """Tokens, the numbers of a text between two ends, and its words outside the head with type and frequency."""
        words, h = words_of(text), len(self.place)
        at = np.fromiter(map(self.cache.__getitem__, words), np.int64, len(words))
        tail = Counter([words[i] for i in np.flatnonzero(at >= h).tolist()])
        numbers = np.concatenate([[h], at, [h]]).astype("<i4")
        return (len(words) + 1, numbers.tobytes(), [w.decode("utf-8", "replace") for w in tail],
                [self.cache[w] - h for w in tail], list(tail.values()))


def _neighbours(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of adjacent numbers, none across two texts."""
    texts = batch.column(0).to_pylist()
    numbers = np.frombuffer(b"".join(texts), "<i4").astype(np.int64)
    inside = np.ones(len(numbers), bool)
    inside[np.cumsum([len(t) // 4 for t in texts], dtype=np.int64) - 1] = False
    at = np.flatnonzero(inside)
    return numbers[at], numbers[at + 1]


def count_pairs(numbers: DataFrame, shared, size: int) -> np.ndarray:
    """Bigrams of codes below ``size`` (a matrix), ``shared`` being the broadcast code of each number."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = shared.value
        total = np.zeros(size ** 2, np.int64)
        for b in batches:
            left, right = _neighbours(b)
            total += np.bincount(code[left] * size + code[right], minlength=len(total))
        at = np.flatnonzero(total)
        for i in range(0, len(at), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(at[i:i + 100_000]), pa.array(total[at[i:i + 100_000]])], ["pair", "n"])
    counted = numbers.mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    pairs, out = counted.toArrow(), np.zeros(size ** 2)                                            # at most size ** 2 rows
    out[pairs["pair"].to_numpy()] = pairs["n"].to_numpy()
    return out.reshape(size, size)


_COUNTED = np.dtype([("key", "<u4"), ("n", "<u4")])


def count_neighbours(numbers: DataFrame, shared, head: int, classes: int) -> DataFrame:
    """(part, counts): for the head's words by part, packed counts of (word, class before | class after | itself)."""
    width = 2 * classes + 1
    if head * width >= 1 << 32:
        raise ValueError("the head times the classes must stay below 2^32")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = shared.value

        def merge(parts):
            keys, n = (np.concatenate(x) for x in zip(*parts))
            order = np.argsort(keys, kind="stable")
            keys, n = keys[order], n[order]
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            return keys[first], np.add.reduceat(n, first)

        def hand_on(keys, n):
            part = keys // width % PARTS
            order = np.argsort(part, kind="stable")
            rows = np.empty(len(keys), _COUNTED)
            rows["key"], rows["n"] = keys[order], n[order]
            ends = np.cumsum(np.bincount(part, minlength=PARTS))
            used = [(p, rows[start:stop].tobytes()) for p, (start, stop) in enumerate(zip([0, *ends[:-1]], ends)) if stop > start]
            return pa.RecordBatch.from_arrays([pa.array([u[0] for u in used], pa.int32()),
                                               pa.array([u[1] for u in used], pa.binary())], ["part", "counts"])
        held, size = [], 0
        for b in batches:
            left, right = _neighbours(b)
            same = (left == right) & (left < head)
            before, after = (right < head) & ~same, (left < head) & ~same
            keys = np.concatenate([right[before] * width + code[left[before]],
                                   left[after] * width + classes + code[right[after]], left[same] * width + 2 * classes])
            if not len(keys):
                continue
            held.append((keys, np.ones(len(keys), np.int64)))
            size += len(keys)
            if size > 8 * FLUSH:
                held = [merge(held)]
                size = len(held[0][0])
                if size > 4 * FLUSH:
                    yield hand_on(*held[0])
                    held, size = [], 0
        if held:
            yield hand_on(*merge(held))
    return numbers.mapInArrow(run, "part int, counts binary")


def move_words(counted: DataFrame, shared, head: int, classes: int) -> DataFrame:
    """(word, class): the best class of every word of the parts; ``shared`` holds the grid, classes and what may move."""
    width = 2 * classes + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grid, label, free = shared.value
        sums: dict[int, np.ndarray] = {}                     # at most head * width numbers in all
        for b in batches:
            for part, packed in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                rows = np.frombuffer(packed, _COUNTED)
                word, code = np.divmod(rows["key"].astype(np.int64), width)
                if part not in sums:
                    sums[part] = np.zeros((-(-(head - part) // PARTS), width))
                np.add.at(sums[part], (word // PARTS, code), rows["n"])
        for part, n in sums.items():
            word = part + PARTS * np.arange(len(n))
            word, n = word[free[word]], n[free[word]]
            for i in range(0, len(word), 500):
                best = best_classes(grid, label[word[i:i + 500]], n[i:i + 500])
                yield pa.RecordBatch.from_arrays([pa.array(word[i:i + 500]), pa.array(best)], ["word", "class"])
    return counted.repartition("part").mapInArrow(run, "word long, class long")


def best_classes(grid: np.ndarray, label: np.ndarray, n: np.ndarray) -> np.ndarray:
    """For each word the class of greatest likelihood, all other words keeping theirs.

    ``n`` holds per word its neighbours' classes before it, those after it, and how often it follows itself.
    Only the classes met beside a word change the sums, so the work follows them.
    """
    k = len(grid)
    before, after, itself = n[:, :k], n[:, k:2 * k], n[:, 2 * k]
    who = np.arange(len(n))

    def side(g, own, other):
        """Change of the sum over the grid's cells (class of the word, neighbour's class)."""
        w, j = np.nonzero(own)
        base = g[:, j].T.copy()                              # [met class, class tried], the word taken out below
        at_home = np.flatnonzero(label[w] == j)
        base[at_home] -= other[w[at_home]]
        base[np.arange(len(w)), label[w]] -= own[w, j]
        base[at_home, j[at_home]] -= itself[w[at_home]]
        change = np.zeros((len(n), k))
        if len(w):
            first = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1]]))
            change[w[first]] = np.add.reduceat(_xlogx(base + own[w, j][:, None]) - _xlogx(base), first)
        return change
    gain = side(grid, after, before) + side(grid.T, before, after)
    corner = np.repeat(np.diagonal(grid)[None].copy(), len(n), 0)
    corner[who, label] -= after[who, label] + before[who, label] + itself
    gain += (_xlogx(corner + after + before + itself[:, None]) - _xlogx(corner)
             - (_xlogx(corner + after) - _xlogx(corner)) - (_xlogx(corner + before) - _xlogx(corner)))
    for total, own in ((grid.sum(1), after), (grid.sum(0), before)):
        count = own.sum(1) + itself
        base = np.repeat(total[None], len(n), 0)
        base[who, label] -= count
        gain -= _xlogx(base + count[:, None]) - _xlogx(base)
    gain[:, 0] = -np.inf                                     # the end's class stays its own
    best = gain.argmax(1)
    return np.where(gain[who, best] > gain[who, label] + 1e-9, best, label)


def _xlogx(x: np.ndarray) -> np.ndarray:
    return np.where(x > 0, x * np.log(np.maximum(x, 1e-300)), 0.0)


def exchange(bigrams: np.ndarray, classes: int = CLASSES, sweeps: int = SWEEPS) -> np.ndarray:
    """Class of each type by exchange clustering; type 0 (the end) keeps class 0 alone."""
    size = len(bigrams)
    k = max(2, min(classes, size))
    freq = bigrams.sum(0) + bigrams.sum(1)
    order = [int(w) for w in np.argsort(-freq, kind="stable") if w]
    label = np.zeros(size, np.int64)
    for r, w in enumerate(order):
        label[w] = 1 + r % (k - 1)
    one = np.zeros((size, k))
    one[np.arange(size), label] = 1
    right = bigrams @ one                                    # [type, class of the word after]
    left = bigrams.T @ one                                   # [type, class of the word before]
    grid = one.T @ right
    for _ in range(sweeps):
        moved = 0
        for w in order:
            if not freq[w]:
                continue
            g, self_n = int(label[w]), bigrams[w, w]
            r, le = right[w].copy(), left[w].copy()          # counts with neighbours by class
            r[g] -= self_n
            le[g] -= self_n
            base = grid.copy()                               # the grid without w
            base[g] -= r
            base[:, g] -= le
            base[g, g] -= self_n
            # without the neighbours' shares: unlike the exact sums (``best_classes``) this leaves poor starts
            rows, cols = base.sum(1), base.sum(0)
            # w in class c: row c gains r, column c gains le, the corner gains the self count
            gain = (_xlogx(base + r) - _xlogx(base)).sum(1) + (_xlogx(base + le[:, None]) - _xlogx(base)).sum(0)
            d = np.diagonal(base)
            gain += (_xlogx(d + r + le + self_n) - _xlogx(d)) - (_xlogx(d + r) - _xlogx(d)) - (_xlogx(d + le) - _xlogx(d))
            gain -= _xlogx(rows + r.sum() + self_n) - _xlogx(rows) + _xlogx(cols + le.sum() + self_n) - _xlogx(cols)
            gain[0] = -np.inf                                # the end's class stays its own
            best = int(gain.argmax())
            if gain[best] <= gain[g] + 1e-9:
                best = g
            grid = base
            grid[best] += r
            grid[:, best] += le
            grid[best, best] += self_n
            if best != g:
                moved += 1
                label[w] = best
                right[:, g] -= bigrams[:, w]
                right[:, best] += bigrams[:, w]
                left[:, g] -= bigrams[w]
                left[:, best] += bigrams[w]
        if not moved:
            break
    return label


class ClassModel:
    """Everything a task needs to score: bounded by the types and the head.

    ``head_class`` holds the class of each word of the head, else it has that of its type.
    """

    def __init__(self, types: Types, label: np.ndarray, grid: np.ndarray, stats: dict[int, tuple], head: dict[bytes, int],
                 train_docs: int, tokens: int, distinct: int, head_class: np.ndarray | None = None):
        self.label, self.head = label, len(head)
        self.tokens, self.distinct, self.ends = tokens, distinct, train_docs
        k = len(grid)
        seen = grid.sum(0)
        prior = (seen + 1.0) / (seen.sum() + k)
        self.step = np.log10((grid + TRANSITION_PRIOR * prior) / (grid.sum(1, keepdims=True) + TRANSITION_PRIOR))
        ones, twos = (sum(s[i] for s in stats.values()) for i in (2, 3))
        self.discount = min(0.9, ones / (ones + 2.0 * twos)) if ones else 0.5    # below the least count
        # per class: log10 of its count, and of the mass kept for unseen words
        self.mass = np.zeros(k)
        self.unseen = np.zeros(k)
        for c, (n, words, _, _) in stats.items():
            self.mass[c] = math.log10(n)
            self.unseen[c] = math.log10(self.discount * words / n)

        # per number of the vocabulary: its class; words outside the head are scored by their counts later
        n_head = np.fromiter(head.values(), float, len(head))
        if head_class is None:
            head_class = np.fromiter((label[types.cache[w]] for w in head), np.int64, len(head))
        self.class_of = np.concatenate([head_class, label])
        self.base_of = np.concatenate([np.log10(n_head + 1), np.zeros(types.size)])
        self.emit_of = np.concatenate([np.log10(np.maximum(n_head - self.discount, 1e-300)) - self.mass[head_class],
                                       np.zeros(types.size)])

    def emission(self, n: int, c: int) -> float:
        return math.log10(n - self.discount) - self.mass[c] if n else self.unseen[c]

    def score(self, packed: bytes) -> tuple:
        """(known, sum of log10(count + 1), log10 probability) of a text's numbers without the words outside the head."""
        at = np.frombuffer(packed, "<i4")
        c, words = self.class_of[at], at[1:-1]
        total = float(self.step[c[:-1], c[1:]].sum() + self.emit_of[words].sum())
        base = math.log10(self.ends + 1) + float(self.base_of[words].sum())
        return int(self.ends > 0) + int((words < self.head).sum()), base, total


def _head(counts: DataFrame, most: int) -> list[tuple[str, int]]:
    """The most frequent words (at most ``most``), by count and then by word.

    A histogram of the counts (a few hundred rows) gives the least count that fits, so no
    task sorts more than its own words and only the head itself is collected.
    """
    size = F.floor(F.log2(F.col("n").cast("double")) * 16).cast("int")
    histogram = sorted(((r[0], r[1]) for r in counts.groupBy(size).count().collect()), reverse=True)
    total, least, part = 0, None, 1.0
    for bucket, n in histogram:
        if total + n > most:
            part = (most - total) / n                        # a bucket that doesn't fit gives a share by hash
            least = bucket
            break
        total, least = total + n, bucket
    if least is None:
        return []
    chosen = (size > least) | ((size == least) & (F.shiftrightunsigned(F.xxhash64("word"), 32) < int(part * 2 ** 32)))
    table = counts.where(chosen).toArrow()                                                         # about ``most`` rows
    return sorted(zip(table["word"].to_pylist(), table["n"].to_pylist()), key=lambda r: (-r[1], r[0]))[:most]


_ENCODED = T.StructType([
    T.StructField("n_tokens", T.LongType()), T.StructField("numbers", T.BinaryType()), T.StructField("word", T.ArrayType(T.StringType())),
    T.StructField("type", T.ArrayType(T.IntegerType())), T.StructField("freq", T.ArrayType(T.LongType()))])
_SCORE = T.StructType([T.StructField("known", T.LongType()), T.StructField("base", T.DoubleType()), T.StructField("score", T.DoubleType())])
_CLASS = T.StructType([T.StructField("class", T.IntegerType())])


def likelihood(grid: np.ndarray) -> float:
    """What the classes change of the training log-likelihood."""
    return float(_xlogx(grid).sum() - _xlogx(grid.sum(0)).sum() - _xlogx(grid.sum(1)).sum())


def learn_classes(numbers: DataFrame, vocabulary: Vocabulary, free: np.ndarray, classes: int = CLASSES,
                  sweeps: int = VOCABULARY_SWEEPS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(class of each type, class of each word of the head, bigrams of classes) from the written ``numbers`` of
    the training texts; ``free`` says which words of the head may leave the class of their type."""
    context, head, size = numbers.sparkSession.sparkContext, len(vocabulary.place), vocabulary.types.size
    bigrams = count_pairs(numbers, context.broadcast(vocabulary.type_of), size)
    label = exchange(bigrams, classes)
    k = int(label.max()) + 1
    member = np.eye(k)[label]
    grid, code = member.T @ bigrams @ member, label[vocabulary.type_of]
    for _ in range(sweeps if free.any() else 0):
        counted = count_neighbours(numbers, context.broadcast(code), head, k)
        moved = move_words(counted, context.broadcast((grid, code[:head], free)), head, k).toArrow()      # at most HEAD rows
        fresh = code.copy()
        fresh[moved["word"].to_numpy()] = moved["class"].to_numpy()
        if (fresh == code).all():
            break
        wanted = count_pairs(numbers, context.broadcast(fresh), k)
        if likelihood(wanted) <= likelihood(grid):
            break
        grid, code = wanted, fresh
    return label, code[:head], grid


def score(docs: DataFrame, train: Column, doc_id: str = "doc_id", text: str = "text", classes: int = CLASSES,
          word_types: int = WORD_TYPES, signature_types: int = SIGNATURE_TYPES, head: int = HEAD,
          sweeps: int = VOCABULARY_SWEEPS) -> DataFrame:
    """Per document: doc_id, trained, n_tokens, n_known, train_tokens, base_score, score, perplexity."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.coalesce(train, F.lit(False)).alias("trained"))
    learned = rows.filter("trained")
    counts = scratch(count_words(learned), "brown-counts")
    ends = learned.count()
    n, v = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    tokens, distinct = n + ends, v + (ends > 0)
    top = _head(counts, head)

    def sign():
        return lambda words: [(signature(w),) for w in words]
    often = [w for w, _ in top[:word_types]]
    rare = counts.filter(F.col("n") <= top[len(often) - 1][1]) if often else counts      # the rest, and ties
    signed = (rare.select("n", text_udf(sign, T.StructType([T.StructField("s", T.StringType())]))("word")["s"].alias("s"))
              .groupBy("s").agg(F.sum("n").alias("n")))
    signatures = [r[0] for r in signed.orderBy(F.desc("n"), "s").limit(signature_types).collect()]
    types = Types(often, signatures)
    vocabulary = Vocabulary(types, [w.encode() for w, _ in top])
    shared = spark.sparkContext.broadcast(vocabulary)

    def encoder():
        v = shared.value
        return lambda texts: [v.encode(t) for t in texts]
    written = scratch(rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "trained",
                                  text_udf(encoder, _ENCODED)("text").alias("s")), "brown-numbers")
    free = np.array([i >= len(often) and c >= LEAST_SEEN for i, (_, c) in enumerate(top)], bool)
    label, head_class, grid = learn_classes(written.filter("trained").select("s.numbers"), vocabulary, free, classes, sweeps)
    class_of = spark.sparkContext.broadcast(np.concatenate([head_class, label]))

    def classify():
        v, c = shared.value, class_of.value
        return lambda words: [(int(c[v.cache[w.encode()]]),) for w in words]
    stats = {r[0]: tuple(r[1:]) for r in counts.select("n", text_udf(classify, _CLASS)("word")["class"].alias("c"))
             .groupBy("c").agg(F.sum("n"), F.count(F.lit(1)), F.sum((F.col("n") == 1).cast("long")),
                               F.sum((F.col("n") == 2).cast("long"))).collect()}
    model = ClassModel(types, label, grid, stats, {w.encode(): c for w, c in top}, ends, tokens, distinct, head_class)
    shared_model = spark.sparkContext.broadcast(model)

    def scorer():
        m = shared_model.value
        return lambda texts: [m.score(t) for t in texts]
    local = written.select("row", "doc_id", "trained", F.col("s.n_tokens").alias("n_tokens"),
                           text_udf(scorer, _SCORE)("s.numbers").alias("s"))
    tail = written.select("row", F.explode(F.arrays_zip("s.word", "s.type", "s.freq")).alias("t")).select(
        "row", "t.word", "t.freq", F.element_at(F.array(*[F.lit(int(c)) for c in label]), F.col("t.type") + 1).alias("class"))
    table = F.create_map(*[F.lit(x) for c in range(len(grid)) for x in (c, F.struct(
        F.lit(float(model.mass[c])).alias("mass"), F.lit(float(model.unseen[c])).alias("unseen")))])
    joined = tail.join(counts.withColumnRenamed("word", "w"), F.col("word") == F.col("w"), "left")
    per = table[F.col("class")]
    emitted = F.when(F.col("n").isNull(), per["unseen"]).otherwise(F.log10(F.col("n") - model.discount) - per["mass"])
    sums = joined.groupBy(F.col("row").alias("r")).agg(
        F.sum(F.col("freq") * F.log10(F.coalesce("n", F.lit(0)) + 1.0)).alias("base"),
        F.sum(F.col("freq") * emitted).alias("score"),
        F.sum(F.when(F.col("n").isNotNull(), F.col("freq")).otherwise(0)).alias("known"))
    out = local.join(sums, local.row == sums.r, "left")
    zero = F.lit(0.0)
    total = F.col("s.score") + F.coalesce(sums["score"], zero)
    return out.select(
        "doc_id", "trained", "n_tokens", (F.col("s.known") + F.coalesce(sums["known"], F.lit(0))).alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("s.base") + F.coalesce(sums["base"], zero)
         - F.col("n_tokens") * math.log10(tokens + distinct + 1)).alias("base_score"),
        total.alias("score"), F.pow(F.lit(10.0), -total / F.col("n_tokens")).alias("perplexity"))


def split_training(doc_id: str = "doc_id") -> Column:
    """Rows that may be learned from: remainder of the id's crc32 by 7 is not 2."""
    return crc_mod(doc_id, 7) != 2
