"""Main-text extraction with gradient-boosted trees over DOM nodes.

A page is parsed (leniently: unclosed and truncated markup is closed as browsers do) to
the tree of its block elements.  Every node gets features: tag kind, attribute tokens,
depth, place among its siblings, length, link density, text density and
punctuation of its subtree, its share of the page, and what holds for its ancestors.
Boosted trees (Spark MLlib) give each node the probability of belonging to the
main text.  Decoding is hierarchical: the labels with the largest joint log-probability
are chosen such that a kept node has only kept ancestors, by one pass up and one down
the tree, so that ancestor and descendant can't contradict each other.

The trees are fitted on a bounded sample: the ``TRAIN_PAGES`` different pages with the smallest hashes
of their html, which a teacher labels by landmarks and attribute tokens (where a page has none, by
where its paragraphs are).  Each sampled page is also shown in ``FORMS`` changed forms: its
landmark under other names, shorter texts, other blocks of text, and blocks of page furniture put in and around the article,
so that the trees learn features instead of one site's template.

All pages are extracted whole.  Scripts, styles, head, and other invisible elements are
markup and never text.  Self-closing ones (but scripts and styles) are empty; pictures, buttons and other
nested ones without an end reach to the next block.

Defined results: null and empty html give an empty text; html without a kept block
gives an empty text; without any page, or if all nodes of the sample have one label, nothing is
fitted and the teacher's rule decides, with a warning; repeated rows and further columns pass through alike.
"""

from __future__ import annotations

import html as html_lib
import random
import re
import warnings
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import scratch, small_batches, text_udf

TRAIN_PAGES = 250
FORMS = 5
TREES = 30
DEPTH = 5

# Element kinds of HTML, and attribute tokens by what they commonly mark.
KINDS = {k: i for i, names in enumerate((
    "article main", "h1 h2 h3 h4 h5 h6", "p blockquote pre figcaption dd td address", "ul ol li dl dt menu", "nav", "aside",
    "footer", "header", "form fieldset legend label dialog", "div section table tbody thead tfoot tr th figure details summary "
    "center body html hgroup caption")) for k in names.split()}
SKIPPED = frozenset("script style head title noscript template iframe svg canvas audio video object select textarea button datalist "
                    "applet".split())
GOOD = frozenset("article articlebody content main post entry story text body prose blog news page hentry maincontent".split())
BAD = frozenset("nav navbar navigation menu menubar footer header masthead sidebar aside ad ads adv advert advertisement advertising banner "
                "sponsor sponsored promo promotion cookie cookies consent notice gdpr privacy popup modal overlay alert toast social share "
                "sharing related recommended more widget breadcrumb breadcrumbs pagination pager newsletter subscribe signup "
                "login search form toolbar tags meta copyright legal dfp taboola outbrain skip toc complementary contentinfo".split())
TALK = frozenset("comment comments commentlist reply replies respond disqus discussion reviews guestbook feedback".split())
#: Elements that are hidden with all they hold, and may nest.
HELD = frozenset("svg canvas audio video object select button datalist applet".split())
CLOSES_P = frozenset(KINDS) - {"html", "body"}
WITHIN = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dt", ("dl",)), "dd": ("dd", ("dl",)),
          "tr": ("tr", ("table", "tbody", "thead", "tfoot")), "td": ("td", ("tr", "table")), "th": ("th", ("tr", "table"))}

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<raw>script|style|(?:title|textarea|noscript|template|iframe)(?![^>]*/>))(?=[\s/>])[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|</(?P<end>[a-z][^\s/>]*)[^>]*(?:>|\Z)"
    r"|<(?P<tag>[a-z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)"
    r"|<(?P<odd>[a-z][^\s/>]*)[^>]*(?:>|\Z)", re.I | re.S)
_HELD = re.compile(rf"<(?:{'|'.join(sorted(HELD))})(?=[\s/>])", re.I)
_ATTR = re.compile(r"\b(?:class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_MARKS = re.compile(r"[.,;:!?…。、]")

FEATURES = 30


class Page:
    """The tree of block elements and the page's text runs, in page order."""

    __slots__ = ("tag", "parent", "depth", "tokens", "runs", "shown")

    def __init__(self, source: str):
        self.tag, self.parent, self.depth, self.tokens = ["html"], [-1], [0], [()]
        self.runs: list[list] = []               # [node, text, characters inside links]
        self.shown = [True]
        self._parse(source)

    def _parse(self, source: str) -> None:
        stack, at, link = [0], 0, False
        run: list[str] = []
        linked = 0

        def flush():
            nonlocal run, linked
            if run:
                text = " ".join(html_lib.unescape("".join(run)).split())
                if text:
                    self.runs.append([stack[-1], text, min(linked, len(text))])
                run, linked = [], 0

        held = self._held(source) if _HELD.search(source) else {}
        for m in _TOKEN.finditer(source):
            if m.start() < at:                           # inside a hidden element
                continue
            if m.start() > at:
                piece = source[at:m.start()]
                run.append(piece)
                linked += len(piece) if link else 0
            at = m.end()
            name = m["tag"] or m["odd"]
            if name:
                name = name.lower()
                if name not in KINDS:
                    if name == "a":
                        link = True
                    elif name in ("br", "hr", "img", "input", "wbr"):
                        run.append("" if name == "wbr" else " ")
                    elif m.start() in held:
                        at = held[m.start()]
                    elif name in SKIPPED and not (m["attrs"] or "").rstrip().endswith("/"):
                        flush()
                        stack.append(self._node(name, stack[-1], (), False))
                    continue
                flush()
                link = False
                self._close(stack, "head", ())           # page content ends an unclosed head
                while self.tag[stack[-1]] in HELD:       # or any other hidden element without an end
                    stack.pop()
                if name in CLOSES_P:
                    self._close(stack, "p", ("td", "li", "div", "article", "section", "main"))
                if name in WITHIN:
                    self._close(stack, *WITHIN[name])
                    if name in ("dd", "dt"):
                        self._close(stack, "dt" if name == "dd" else "dd", ("dl",))
                    if name in ("td", "th"):
                        self._close(stack, "th" if name == "td" else "td", ("tr", "table"))
                if name == "html":
                    continue
                attrs = m["attrs"] or ""
                tokens = ()
                if "=" in attrs:
                    values = " ".join("".join(v) for v in _ATTR.findall(attrs))
                    tokens = tuple(w.lower() for w in _WORD.findall(values))
                    if "hidden" in attrs.lower() and re.search(r"(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none", attrs, re.I):
                        tokens += ("hidden",)
                stack.append(self._node(name, stack[-1], tokens, "hidden" not in tokens))
            elif m["end"]:
                name = m["end"].lower()
                if name == "a":
                    link = False
                elif name in KINDS or name in SKIPPED:
                    flush()
                    link = False
                    if name not in ("html", "body"):     # what follows </body> still belongs to it
                        self._close(stack, name, ())
            # comments, declarations and raw text elements vanish
        if at < len(source):
            run.append(source[at:])
        flush()

    @staticmethod
    def _held(source: str) -> dict[int, int]:
        """Where hidden elements that have an end begin -> where they end; the block around them must not end before."""
        ends: dict[int, int] = {}
        stack: list[tuple[str, int]] = []
        for m in _TOKEN.finditer(source):
            name = (m["tag"] or m["odd"] or m["end"] or "").lower()
            if name not in HELD and name not in KINDS:
                continue
            if not m["end"]:
                if name in KINDS or not (m["attrs"] or "").rstrip().endswith("/"):
                    stack.append((name, m.start()))
                continue
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    if name in HELD:
                        ends[stack[i][1]] = m.end()
                    del stack[i:]
                    break
        return ends

    def _node(self, tag: str, parent: int, tokens: tuple, shown: bool) -> int:
        self.tag.append(tag)
        self.parent.append(parent)
        self.depth.append(self.depth[parent] + 1)
        self.tokens.append(tokens)
        self.shown.append(shown and self.shown[parent])
        return len(self.tag) - 1

    def _close(self, stack: list[int], name: str, stop: tuple) -> None:
        for i in range(len(stack) - 1, 0, -1):
            t = self.tag[stack[i]]
            if t == name:
                del stack[i:]
                return
            if t in stop:
                return

    # -- features ------------------------------------------------------------------

    def features(self) -> np.ndarray:
        n = len(self.tag)
        parent = np.array(self.parent)
        chars, links, marks, runs, words = (np.zeros(n) for _ in range(5))
        for node, text, inside in self.runs:
            if self.shown[node]:
                chars[node] += len(text)
                links[node] += inside
                marks[node] += len(_MARKS.findall(text))
                words[node] += text.count(" ") + 1
                runs[node] += 1
        own = chars.copy()
        tags, paragraphs = np.ones(n), np.array([1.0 if t == "p" else 0.0 for t in self.tag])
        kind = np.array([KINDS.get(t, 9) for t in self.tag])
        children = np.zeros(n)
        index = np.zeros(n)
        for v in range(1, n):
            index[v] = children[parent[v]]
            children[parent[v]] += 1
        for v in range(n - 1, 0, -1):            # children come after their parents
            p = parent[v]
            for a in (chars, links, marks, runs, words, tags, paragraphs):
                a[p] += a[v]
        x = np.zeros((n, FEATURES))
        x[np.arange(n), kind] = 1
        good = np.array([sum(w in GOOD for w in t) for t in self.tokens])
        bad = np.array([sum(w in BAD for w in t) for t in self.tokens])
        talk = np.array([sum(w in TALK for w in t) for t in self.tokens])
        good_path, bad_path, talk_path, within = (np.zeros(n) for _ in range(4))
        for v in range(1, n):                    # sums on the way down to the node, itself included
            p = parent[v]
            good_path[v] = good_path[p] + good[v]
            bad_path[v] = bad_path[p] + bad[v] + (kind[v] in (4, 5, 6, 8)) + (kind[v] == 7 and not within[p])
            talk_path[v] = talk_path[p] + talk[v]
            within[v] = max(within[p], float(kind[v] == 0))
        up = np.maximum(parent, 0)
        density = links / np.maximum(chars, 1)
        same = np.zeros(n)
        siblings: dict[tuple, int] = {}
        for v in range(1, n):
            siblings[(parent[v], self.tag[v])] = siblings.get((parent[v], self.tag[v]), 0) + 1
        for v in range(1, n):
            same[v] = siblings[(parent[v], self.tag[v])] / children[parent[v]]
        x[:, 10], x[:, 11], x[:, 12] = np.minimum(good, 3), np.minimum(bad, 3), np.minimum(talk, 2)
        x[:, 13], x[:, 14], x[:, 15], x[:, 16] = (np.minimum(good_path, 3), np.minimum(bad_path, 3), np.minimum(talk_path, 2), within)
        x[:, 17] = np.minimum(self.depth, 20)
        x[:, 18] = index / np.maximum(children[up], 1)
        x[:, 19] = np.log1p(children[up])
        x[:, 20] = same
        x[:, 21] = np.log1p(chars)
        x[:, 22] = density
        x[:, 23] = np.log1p(chars / tags)
        x[:, 24] = marks / np.maximum(chars, 1) * 100
        x[:, 25] = chars / max(chars[0], 1)
        x[:, 26] = np.log1p(words / np.maximum(runs, 1))
        x[:, 27] = density[up]
        x[:, 28] = paragraphs / np.maximum(tags, 1)
        x[:, 29] = np.log1p(own)
        return x

    # -- the teacher -----------------------------------------------------------------

    def teach(self) -> np.ndarray:
        """Weak labels: inside the landmark (or a container named like one) and not in page furniture."""
        n = len(self.tag)
        kind = [KINDS.get(t, 9) for t in self.tag]
        roots = [v for v in range(n) if kind[v] == 0]
        if not roots:
            roots = [v for v in range(1, n) if kind[v] == 9 and self.tag[v] not in ("body", "html")
                     and any(w in GOOD for w in self.tokens[v]) and not any(w in BAD or w in TALK for w in self.tokens[v])]
        if not roots:                            # the container whose own paragraphs hold most text
            weight: dict[int, int] = {}
            for node, text, inside in self.runs:
                if kind[node] == 2 and not inside:
                    weight[self.parent[node]] = weight.get(self.parent[node], 0) + len(text)
            roots = [max(weight, key=lambda v: (weight[v], -v))] if weight else []
        keep = np.zeros(n, bool)
        root = set(roots)
        for v in range(n):
            p = self.parent[v]
            furniture = kind[v] in (4, 5, 6, 8) or (kind[v] == 7 and not keep[p]) or any(w in BAD or w in TALK for w in self.tokens[v])
            keep[v] = self.shown[v] and (v in root and not (furniture and kind[v] != 0) or p >= 0 and keep[p] and not furniture)
        for v in sorted(root):                   # the way down to the landmark is kept too
            while v > 0 and keep[v] and not keep[self.parent[v]]:
                v = self.parent[v]
                keep[v] = True
        keep[0] = True
        return keep

    # -- decoding --------------------------------------------------------------------

    def decode(self, p: np.ndarray) -> np.ndarray:
        """The most probable labels among those where kept nodes have kept ancestors."""
        p = np.clip(p, 1e-4, 1 - 1e-4)
        weight = np.ones(len(p))
        for node, text, _ in self.runs:          # a node counts as much as the text it decides on
            weight[node] += len(text) ** 0.5
        keep, drop = np.log(p) * weight, np.log(1 - p) * weight
        for v in range(len(p) - 1, 0, -1):
            keep[self.parent[v]] += max(keep[v], drop[v])
            drop[self.parent[v]] += drop[v]
        out = np.ones(len(p), bool)
        for v in range(1, len(p)):
            out[v] = out[self.parent[v]] and self.shown[v] and keep[v] > drop[v]
        return out

    def text(self, kept: np.ndarray) -> str:
        return "\n\n".join(text for node, text, _ in self.runs if kept[node])


# --- changed pages for training --------------------------------------------------------

_LANDMARKS = ("<article>", "<main>", '<div class="post-content">', '<div id="main-content">', '<section class="entry">',
              '<div class="story-body">', '<div itemprop="articleBody">', '<div class="article text">', "<div>", "<section>", "")
_AROUND = ('<div class="{}">{}</div>', '<section id="{}">{}</section>', '<aside class="{}">{}</aside>', '<div role="{}"><p>{}</p></div>',
           '<form class="{}"><label>{}</label><input name="q"></form>', '<ul class="{}"><li><a href="#">{}</a></li></ul>',
           '<header class="{}"><p>{}</p></header>', '<footer id="{}"><p>{}</p></footer>', '<nav class="{}"><a href="#">{}</a></nav>',
           '<div class="{}"><div><p>{}</p><p><a href="#">x</a></p></div></div>', "<aside><!-- {} --><p>{}</p></aside>",
           "<form><!-- {} --><p>{}</p><input></form>", '<div id="{}"><h1>{}</h1><p>x</p></div>', '<header class="{}"><h1>{}</h1></header>')
_TEXT = re.compile(r">([^<>]{20,})<")


def changed(source: str, seed: int) -> str:
    """The page with its landmark renamed and page furniture of the page's own words added."""
    rng = random.Random(seed)
    texts = _TEXT.findall(source) or ["Text"]
    names = sorted(BAD | TALK)

    def block(_=None) -> str:
        words = " ".join(rng.choice(texts) for _ in range(rng.randint(1, 4))).split()
        cut = " ".join(words[:rng.choice((3, 8, 20, 60, 150))])
        shape = rng.choice(_AROUND)
        body = shape.format(rng.choice(names), cut)
        if rng.random() < 0.3:                   # comment threads repeat
            one = rng.choice(sorted(TALK))
            body = f'<div class="{one}s">' + "".join(f'<div class="{one}"><p>{cut}</p></div>' for _ in range(rng.randint(1, 5))) + "</div>"
        return body
    alone = re.search(r"<(article|main)\b.*</\1>", source, re.I | re.S)
    if alone and rng.random() < 0.25:            # nothing but the article
        source = alone[0]
    if rng.random() < 0.5:                       # few paragraphs
        few = iter([rng.random() < 0.6 for _ in range(rng.randint(1, 4))])
        source = re.sub(r"<p>[^<]*</p>", lambda m: m[0] if next(few, False) else "", source)
    if rng.random() < 0.5:                       # short texts
        source = re.sub(r">([^<>]{20,})<", lambda m: ">" + " ".join(m[1].split()[:rng.randint(1, 30)]) + "<", source)
    if rng.random() < 0.4:                       # other blocks of running text
        other = rng.choice(("<blockquote>{}</blockquote>", "<ul><li>{}</li><li>{}</li></ul>", "<h2>{}</h2>", "<div>{}</div>",
                            "<figure><figcaption>{}</figcaption></figure>", "<table><tr><td>{}</td><td>{}</td></tr></table>",
                            "<pre>{}</pre>", "<section><h3>{}</h3><p>{}</p></section>"))
        words = " ".join(rng.choice(texts).split()[:rng.randint(2, 25)])
        source = re.sub(r"</p>(?=\s*<p)", lambda m: m[0] + (other.replace("{}", words) if rng.random() < 0.3 else ""), source)
    opening = rng.choice(_LANDMARKS)
    closing = "</" + re.match(r"<(\w+)", opening)[1] + ">" if opening else ""
    out = re.sub(r"<(article|main)\b[^>]*>", lambda m: block() * rng.randint(0, 1) + opening, source, flags=re.I)
    out = re.sub(r"</(article|main)>", lambda m: (block() if rng.random() < 0.4 else "") + closing + "".join(
        block() for _ in range(rng.randint(0, 3))), out, flags=re.I)
    return re.sub(r"(</p>)(?=\s*<p)", lambda m: m[1] + (block() if rng.random() < 0.06 else ""), out, flags=re.I)


def training_nodes(source: str) -> list[dict]:
    """Features and labels of a page and of its changed forms."""
    seed = zlib.crc32(source.encode("utf-8", "replace"))
    out = []
    for page in [Page(source), *[Page(changed(source, seed + k)) for k in range(FORMS)]]:
        out += [{"x": f.tolist(), "y": float(k)} for f, k in zip(page.features(), page.teach())]
    return out


_NODES = T.StructType([T.StructField("nodes", T.ArrayType(T.StructType([
    T.StructField("x", T.ArrayType(T.DoubleType())), T.StructField("y", T.DoubleType())])))])


class Boosted:
    """Fitted trees as arrays: evaluated in the tasks without a Spark session."""

    def __init__(self, trees: list[tuple], weights: list[float]):
        self.trees, self.weights = trees, weights

    def probability(self, x: np.ndarray) -> np.ndarray:
        margin = np.zeros(len(x))
        for (feature, threshold, left, right, value), w in zip(self.trees, self.weights):
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                f = feature[at]
                inner = f >= 0
                goes = x[np.arange(len(x)), np.maximum(f, 0)] <= threshold[at]
                at = np.where(inner, np.where(goes, left[at], right[at]), at)
            margin += w * value[at]
        return 1 / (1 + np.exp(-2 * margin))


def _arrays(root) -> tuple:
    feature, threshold, left, right, value = [], [], [], [], []

    def walk(node) -> int:
        i = len(feature)
        for column in (feature, threshold, left, right, value):
            column.append(0)
        if node.getClass().getSimpleName() == "LeafNode":
            feature[i], value[i] = -1, node.prediction()
        else:
            split = node.split()
            feature[i], threshold[i] = split.featureIndex(), split.threshold()
            left[i], right[i] = walk(node.leftChild()), walk(node.rightChild())
        return i
    walk(root)
    return np.array(feature), np.array(threshold), np.array(left), np.array(right), np.array(value)


def sample_pages(pages: DataFrame, html: str = "html", train_pages: int = TRAIN_PAGES) -> DataFrame:
    """``h, html``: the ``train_pages`` different pages with the smallest hashes of their html.

    Copies count once and neither the order of rows nor the layout of files matters; a table with any page yields some.
    """
    rows = pages.select(F.col(html).alias("html")).filter(F.length("html") > 0).select(F.xxhash64("html").alias("h"), "html")
    chosen = rows.select("h").distinct().orderBy("h").limit(train_pages)          # at most train_pages rows of 8 bytes
    return rows.join(F.broadcast(chosen), "h", "left_semi").groupBy("h").agg(F.min("html").alias("html"))


def fit(pages: DataFrame, html: str = "html", train_pages: int = TRAIN_PAGES) -> Boosted | None:
    """Boosted trees from a bounded sample of the pages; None (with a warning) if its nodes all have one label."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector
    sample = sample_pages(pages, html, train_pages)

    def make():
        return lambda texts: [(training_nodes(t),) for t in texts]
    nodes = scratch(sample.repartition(8, "h").select(F.explode(text_udf(make, _NODES)("html")["nodes"]).alias("n"))
                    .select(array_to_vector("n.x").alias("features"), F.col("n.y").alias("label")), "extract-nodes")
    if nodes.select("label").distinct().count() < 2:
        warnings.warn("no page to fit trees on, or all nodes have one label: the teacher's rule decides", stacklevel=2)
        return None
    model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, maxBins=32, seed=7, cacheNodeIds=False).fit(nodes)
    return Boosted([_arrays(t._java_obj.rootNode()) for t in model.trees], list(model.treeWeights))


_OUT = T.StructType([T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])


def extract_batch(sources: list, model: Boosted | None) -> list[tuple]:
    pages = [Page(s) if s else None for s in sources]
    found = [p for p in pages if p is not None]
    if model is not None and found:
        x = [p.features() for p in found]
        ends = np.cumsum([len(f) for f in x])
        parts = iter(np.split(model.probability(np.concatenate(x)), ends[:-1]))
    out = []
    for p in pages:
        if p is None:
            out.append(("", 0))
            continue
        text = p.text(p.teach() if model is None else p.decode(next(parts)))
        out.append((text, len(text)))
    return out


def extract(pages: DataFrame, html: str = "html", model: Boosted | None = None, fitted: bool = False) -> DataFrame:
    """Adds ``main`` = struct(text, n_chars) to every page; fits the trees unless they are given."""
    spark = pages.sparkSession
    small_batches(spark)
    trees = spark.sparkContext.broadcast(model if fitted else fit(pages, html))      # a few kilobytes

    def make():
        m = trees.value
        return lambda sources: extract_batch(sources, m)
    return pages.withColumn("main", text_udf(make, _OUT)(html))
