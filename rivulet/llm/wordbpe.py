"""BPE encoding and decoding with a tokenization automaton.

The merge list is compiled, merge by merge, into a deterministic automaton over
tokens that accepts exactly the correct tokenization of every word.  It starts as
one state with a loop for each symbol.  The gadget of the merge ``(u, v) -> w``

* gives ``u`` a new target state: a copy of its old one without the arc ``v``
  (after a ``u`` that stayed unmerged, ``v`` can't follow any more);
* adds the arc ``w`` to every state that had an arc ``u`` leading to an arc ``v``;
  ``w`` leads where ``v`` led from there.

All arcs with one label share one target, so a state is named by the label that
leads to it.  A copied state differs from its origin by single arcs only, so states
share their arcs structurally: for each token the automaton stores when its state
was made, from which state it was copied, and (by the merge table) when which arc
was cut.  ``MergeAutomaton.arc`` resolves one (state, token) entry through these
records and keeps it in the transition table, so the table holds the entries that
the corpus uses instead of states x tokens.

Encoding a pre-split word follows transitions whose labels spell the word.  The
accepted path is unique for every prefix, so a position that fails once is never
tried again and the walk is linear in the word.  Decoding emits the arc labels of
the path.

Defined results: a null text encodes like an empty one (no ids, empty decoded text);
very long texts are walked word by word; repeated rows and further columns pass
through unchanged; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import sys
import unicodedata
from array import array
from functools import lru_cache

import numpy as np
import public_tokenizers
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import RecentCache, small_batches, text_udf

VOCABULARY = "word_bpe_49k.json"

# Split pattern, word end and byte alphabet of the public vocabulary file.
SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{White_Space}\p{L}\p{N}]+")
END = "\n"
SPACE = regex.compile(r"\p{White_Space}+")


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    table = {b: chr(b) for b in plain}
    spare = iter(range(256, 512))
    return [table[b] if b in table else chr(next(spare)) for b in range(256)]


def packed(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    a = array("I", ids)
    if sys.byteorder == "big":
        a.byteswap()
    return a.tobytes()


BYTES = byte_alphabet()


def pieces(word: str) -> list[str]:
    """Normalized, pre-split pieces of a run without white space, as byte-level symbols."""
    if word.isascii():
        word = word.lower()
    else:
        word = unicodedata.normalize("NFC", word)
        word = "".join([c.lower() for c in word])        # character by character
    if word.isalpha():
        found = [word]
    elif word[:-1].isalpha() and word[-1] in ".,":
        found = [word[:-1], word[-1]]
    else:
        found = SPLIT.findall(word)
    return [p if p.isascii() and p.isprintable() else "".join([BYTES[b] for b in p.encode()]) for p in found]


def words_of(text: str) -> list[str]:
    """Runs between Unicode white space.

    Latin-1 text is lower-cased at once: there the order of lower-casing and
    normalizing doesn't matter, and fewer different words are left to remember.
    """
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        pass
    else:
        text = text.lower()
    if any(c in text for c in "\x1c\x1d\x1e\x1f"):       # str.split knows four more separators
        return [w for w in SPACE.split(text) if w]
    return text.split()


class MergeAutomaton:
    """The automaton of a merge list; arcs are resolved on first use and kept."""

    def __init__(self, merges: list[tuple[str, str]], vocab: dict[str, int]):
        self.vocab = vocab
        size = max(vocab.values(), default=-1) + 1
        self.made = [0] * size                  # merge step that made the token (0: a symbol)
        self.left, self.right = [-1] * size, [-1] * size
        self.cut: dict[int, int] = {}           # left * size + right -> step of the gadget
        self.size = size
        self.arcs: dict[int, bool] = {}         # the transition table
        for step, (u, v) in enumerate(merges, 1):
            self._gadget(step, vocab[u], vocab[v], vocab[u + v])
        reached = [True] * size                 # is the token's own spelling tokenized as itself?
        for w in sorted(range(size), key=self.made.__getitem__):
            if self.made[w]:
                u, v = self.left[w], self.right[w]
                reached[w] = reached[u] and reached[v] and self._open(u, v, self.made[w] - 1)
        self.spellings = {label: i for label, i in vocab.items() if reached[i]}
        self.reach: dict[str, int] = {}         # three symbols -> longest token that starts with them
        for label in self.spellings:
            if len(label) > 2:
                head = label[:3]
                self.reach[head] = max(self.reach.get(head, 0), len(label))

    def _gadget(self, step: int, u: int, v: int, w: int) -> None:
        self.cut.setdefault(u * self.size + v, step)
        if not self.made[w] and self.left[w] < 0:
            self.made[w], self.left[w], self.right[w] = step, u, v

    def _open(self, state: int, token: int, step: int) -> bool:
        """Has ``state`` an arc ``token`` once the gadgets up to ``step`` are built?"""
        while True:
            if self.cut.get(state * self.size + token, step + 1) <= step:
                return False
            born, arrived = self.made[state], self.made[token]
            if arrived >= born:
                if not arrived:
                    return True                  # two symbols: the loops of the start state
                token, step = self.left[token], arrived      # w was added beside its u
            else:
                state, step = self.right[state], born - 1    # copied from the target of v

    def arc(self, state: int, token: int) -> bool:
        """The table entry of ``state`` (times size) and ``token``, made now."""
        known = self.arcs[state + token] = self._open(state // self.size, token, len(self.made))
        return known

    def walk(self, word: str) -> list[int]:
        """Labels of the accepted path that spells ``word``, its word end included."""
        vocab, arcs, size, reach = self.spellings, self.arcs, self.size, self.reach
        whole = vocab.get(word)
        if whole is not None:
            return [whole]
        n = len(word)
        path: list[int] = []
        stops: list[int] = []                    # where the token of each level ended
        failed = ()
        at, state, stop = 0, None, reach.get(word[:3], 2)
        while True:
            for stop in range(stop if stop < n else n, at, -1):
                token = vocab.get(word[at:stop])
                if token is None or stop in failed:
                    continue
                if state is None:
                    break
                ok = arcs.get(state + token)
                if ok or ok is None and self.arc(state, token):
                    break
            else:                                # no arc fits: the position is off the path
                failed = {*failed, at}
                path.pop()
                stop = stops.pop() - 1
                at, state = (stops[-1], path[-1] * size) if path else (0, None)
                continue
            path.append(token)
            if stop == n:
                return path
            stops.append(stop)
            at, state = stop, token * size
            stop = at + reach.get(word[at:at + 3], 2)


class WordBpe:
    """Whole texts to ids and back, as the vocabulary file's normalizer and splitter say."""

    def __init__(self, path: str, by_library: bool = False):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        # the word end is one character that no byte stands for, so every symbol has a known length
        suffix = model["end_of_word_suffix"]

        def spell(label: str) -> str:
            return label.removesuffix(suffix) + END if label.endswith(suffix) else label
        if by_library:
            self.piece = self._library(path)
        else:
            merges = [m.split(" ", 1) if isinstance(m, str) else m for m in model["merges"]]
            self.automaton = MergeAutomaton([(spell(u), spell(v)) for u, v in merges],
                                            {spell(label): i for label, i in model["vocab"].items()})
            self.piece = self._path
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.marks = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        size = max([*model["vocab"].values(), *self.special.values()]) + 1
        self.wide = size > 1 << 16               # ids need more than 16 bits
        self.labels = [""] * size
        for label, i in [*model["vocab"].items(), *self.special.items()]:
            self.labels[i] = label
        self.cache = RecentCache(self._word, 500_000)

    @staticmethod
    def _library(path: str):
        """Ids of one piece by the tokenizers library instead of the automaton."""
        from tokenizers import Tokenizer
        model = Tokenizer.from_file(path).model
        return lambda piece: [t.id for t in model.tokenize(piece)]

    def _path(self, piece: str) -> list[int]:
        return self.automaton.walk(piece + END)

    def _word(self, word: str) -> bytes:
        """Ids (little-endian 32-bit) of one run of characters without white space."""
        if word[-1] in ".,;:!?" and word[:-1].isalpha() and word[:-1].lower().isalpha():
            return self.cache[word[:-1]] + self.cache[word[-1]]      # two pieces, encoded one by one
        ids: list[int] = []
        for piece in pieces(word):
            ids += self.piece(piece)
        return packed(ids)

    def _plain(self, text: str) -> bytes:
        return b"".join(map(self.cache.__getitem__, words_of(text)))

    def encode(self, text: str | None) -> bytes:
        """All ids of a text as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if self.marks is None or not any(s in text for s in self.special):
            return self._plain(text)
        out, at = [], 0
        for m in self.marks.finditer(text):
            out += [self._plain(text[at:m.start()]), self.special[m.group()].to_bytes(4, "little")]
            at = m.end()
        return b"".join([*out, self._plain(text[at:])])

    def decode(self, ids: bytes) -> str:
        """The labels along the path, joined as the file's (absent) decoder leaves them."""
        return " ".join(map(self.labels.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=4)
def load(path: str, by_library: bool = False) -> WordBpe:
    """One compiled vocabulary per worker process."""
    return WordBpe(path, by_library)


DIGEST = T.StructType([T.StructField("n_tokens", T.LongType()),
                       T.StructField("ids_sha256", T.StringType()),
                       T.StructField("decoded_sha256", T.StringType())])
ROUND_TRIP = T.StructType([T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.StringType())])


def _column(schema, finish, vocabulary: str | None):
    path = vocabulary or public_tokenizers.path(VOCABULARY)

    def make():
        bpe = load(path)

        def run(texts):
            return [finish(bpe, bpe.encode(t)) for t in texts]
        return run
    return text_udf(make, schema)


def _digest(bpe: WordBpe, ids: bytes) -> tuple:
    return (len(ids) // 4, hashlib.sha256(ids).hexdigest(),
            hashlib.sha256(bpe.decode(ids).encode()).hexdigest())


def encode_decode(docs: DataFrame, text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """Adds ``bpe`` = struct(ids, decoded): the ids (packed) and the text decoded from them."""
    small_batches(docs.sparkSession)
    return docs.withColumn("bpe", _column(ROUND_TRIP, lambda b, i: (i, b.decode(i)), vocabulary)(text))


def digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
            vocabulary: str | None = None) -> DataFrame:
    """Per document: number of ids and digests of the ids and of the decoded text."""
    small_batches(docs.sparkSession)
    return (docs.select(doc_id, _column(DIGEST, _digest, vocabulary)(text).alias("_bpe"))
            .select(doc_id, "_bpe.*"))
