"""Token counts by a linear longest-match automaton.

Greedy word-piece tokenization takes the longest vocabulary entry at each position.
The vocabulary is a trie whose nodes carry a failure link and the number of tokens that
taking the link pops: where no child fits the next symbol, the tokens popped so far are
counted, and matching goes on from the linked node, which stands for the symbols that
no popped token has used up.  Every symbol moves down the trie once and every pop
has been paid for by a symbol, so a word's length in tokens costs time linear in
its symbols and no piece is ever built.

Vocabulary entries with the word end match at the end of a word only.  A word that can't
be covered is one unknown token.

Defined results: null and empty texts, or texts of white space, have no word and no
token; special tokens are ordinary text here; repeated rows are counted alike; an
empty table gives an empty result; further columns aren't read.
"""

from __future__ import annotations

import json
from functools import lru_cache

import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import RecentCache, small_batches, text_udf
from .wordbpe import VOCABULARY, pieces, words_of

ROOT = 0


class LongestMatch:
    """Trie over symbols with failure links and popped-token counts.

    ``vocabulary`` holds tuples of symbols; a symbol that ends a word differs from the
    same symbol inside one.
    """

    def __init__(self, vocabulary):
        self.child: list[dict] = [{}]
        final = {}
        for entry in vocabulary:
            node = ROOT
            for symbol in entry:
                step = self.child[node].get(symbol)
                if step is None:
                    step = self.child[node][symbol] = len(self.child)
                    self.child.append({})
                node = step
            final[node] = True
        n = len(self.child)
        self.link = [-1] * n                     # -1: no way to go on
        self.pops = [0] * n
        layer = [ROOT]
        while layer:                             # breadth first: links lead to shorter strings
            below = []
            for u in layer:
                for symbol, v in self.child[u].items():
                    below.append(v)
                    if v in final:
                        self.link[v], self.pops[v] = ROOT, 1
                        continue
                    z, popped = self.link[u], self.pops[u]
                    while z >= 0 and symbol not in self.child[z]:
                        popped += self.pops[z]
                        z = self.link[z]
                    if z >= 0:
                        self.link[v], self.pops[v] = self.child[z][symbol], popped
            layer = below

    def count(self, symbols) -> int:
        """Tokens of one word, or -1 if the vocabulary can't cover it."""
        child, link, pops = self.child, self.link, self.pops
        node = total = 0
        for symbol in symbols:
            step = child[node].get(symbol)
            while step is None:
                if link[node] < 0:
                    return -1
                total += pops[node]
                node = link[node]
                step = child[node].get(symbol)
            node = step
        while node != ROOT:
            if link[node] < 0:
                return -1
            total += pops[node]
            node = link[node]
        return total


def symbols(piece: str) -> list[str]:
    """Symbols of a byte-level piece; the last one carries the word end."""
    return [*piece[:-1], piece[-1] + "</w>"]


class PieceCounter:
    """Counts per run of characters, remembered."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        end = model["end_of_word_suffix"]
        self.automaton = LongestMatch([symbols(t.removesuffix(end)) if t.endswith(end) else list(t)
                                       for t in model["vocab"] if t != end])
        self.cache = RecentCache(self._run)

    def _run(self, run: str) -> tuple[int, int, int]:
        """(words, tokens, unknown words) of one run without white space."""
        words = tokens = unknown = 0
        for piece in pieces(run):
            n = self.automaton.count(symbols(piece))
            words += 1
            unknown += n < 0
            tokens += 1 if n < 0 else n
        return words, tokens, unknown

    def totals(self, text: str | None) -> tuple[int, int, int]:
        if not text:
            return 0, 0, 0
        counts = list(map(self.cache.__getitem__, words_of(text)))
        return tuple(map(sum, zip(*counts))) if counts else (0, 0, 0)


@lru_cache(maxsize=4)
def load(path: str) -> PieceCounter:
    return PieceCounter(path)


_COUNTS = T.StructType([T.StructField(c, T.LongType()) for c in ("n_words", "n_tokens", "n_unknown")])


def token_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """Per document: doc_id, n_words (pre-split), n_tokens (greedy pieces), n_unknown."""
    small_batches(docs.sparkSession)
    path = vocabulary or public_tokenizers.path(VOCABULARY)

    def make():
        totals = load(path).totals
        return lambda texts: [totals(t) for t in texts]
    return (docs.select(F.col(doc_id).alias("doc_id"), text_udf(make, _COUNTS)(text).alias("c"))
            .select("doc_id", "c.*"))
