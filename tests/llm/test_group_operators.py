"""SimHash, lattice hashing, components, packing, extraction and the pipeline against plain versions."""

import random
import zlib
from functools import partial

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
import xxhash
from llm_fixtures import EN, ODD, SMALL
from pyspark.sql import functions as F
from pyspark.sql import types as T
from rivulet.llm import components, extract, lattice, packing, simhash
from tokenizers import Tokenizer


def union_find(n, pairs):
    root = list(range(n))

    def find(a):
        while root[a] != a:
            root[a] = a = root[root[a]]
        return a
    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(a) for a in range(n)]


# --- components -------------------------------------------------------------------------

def test_components_equal_union_find(spark):
    rng = random.Random(2)
    pairs = [(i, i + 1) for i in range(0, 60)]                                    # a long path
    pairs += [(100, 100 + i) for i in range(1, 200)]                              # a hot star
    pairs += [tuple(sorted(rng.sample(range(400, 480), 2))) for _ in range(60)]   # a random graph
    pairs = sorted(set(pairs))
    want = union_find(500, pairs)
    got = {r.node: r.root for r in components.roots(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {n: want[n] for p in pairs for n in p}
    assert components.roots(spark.createDataFrame([], "a long, b long")).count() == 0


# --- 6: SimHash ---------------------------------------------------------------------------

def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    runs = [b" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(table):
    prints = [plain_fingerprint(t) for _, t in table]
    pairs = [(i, j) for i in range(len(table)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 2]
    root = union_find(len(table), pairs)
    low = {}
    for (d, _), r in zip(table, root):
        low[r] = d if r not in low else low[r] if d is None else d if low[r] is None else min(low[r], d)
    return sorted(((d, f"{p:016x}", low[r]) for (d, _), p, r in zip(table, prints, root)), key=repr)


def as_rows(df):
    return sorted(((r.doc_id, r.fingerprint, r.component_id) for r in df.select(
        "doc_id", simhash.hexadecimal(F.col("fp")).alias("fingerprint"), "component_id").collect()), key=repr)


def test_simhash_equals_plain_version(real, odd, none):
    for df in (real, odd):
        assert as_rows(simhash.cluster(df)) == plain_groups([(r.doc_id, r.text) for r in df.collect()])
    assert simhash.cluster(none).count() == 0


def test_hash_is_the_engines_own(spark):
    text = "a b c"
    assert spark.range(1).select(F.xxhash64(F.lit(text))).first()[0] % (1 << 64) == xxhash.xxh64_intdigest(text, 42)


def test_segment_range_join_loses_no_pair(spark):
    rng = random.Random(4)
    prints = [rng.getrandbits(64) for _ in range(150)] + [0, (1 << 64) - 1, 1 << 63, (1 << 63) | 1, 3 << 62]
    for p in prints[:100]:
        for bits in (1, 2, 2, 3):
            q = p
            for b in rng.sample(range(64), bits):
                q ^= 1 << b
            prints.append(q)
    prints = sorted(set(prints))
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    want = {tuple(sorted((signed[i], signed[j]))) for i in range(len(prints)) for j in range(i)
            if (prints[i] ^ prints[j]).bit_count() <= 2}
    nodes = spark.createDataFrame([(p,) for p in signed], "fp long")
    assert {(r.a, r.b) for r in simhash.links(nodes).collect()} == want
    assert {(r.a, r.b) for r in simhash.links(nodes, groups=3).collect()} == want


def test_one_of_each_keeps_one_row_per_group(odd):
    kept = simhash.one_of_each(odd)
    assert kept.columns == odd.columns
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr)
    groups = {}
    for d, _, low in plain_groups([(r[0], r[1]) for r in ODD]):
        groups.setdefault(low, []).append(d)
    assert len(got) == len({p for p in (plain_fingerprint(r[1]) for r in ODD)}) == len(groups)


# --- 5: lattice hashing ---------------------------------------------------------------------

def test_nearest_e8_is_the_nearest():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 8)) * 2
    p = lattice.nearest_e8(x)
    doubled = np.rint(2 * p).astype(int)
    assert np.all((doubled % 2 == doubled[:, :1] % 2)) and np.all(np.rint(p.sum(1)) % 2 == 0)
    d = ((x - p) ** 2).sum(1)
    for r in lattice.ROOTS:                        # no neighbour is nearer
        assert np.all(((x - p - r) ** 2).sum(1) >= d - 1e-9)


def planted(n=300, dim=64, seed=1):
    """Vectors with partners at chosen cosines, a dense group, and copies."""
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, dim))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    rows = list(base)
    for cos in (0.931, 0.94, 0.96, 0.929, 0.90):
        z = rng.normal(size=base.shape)
        z -= (z * base).sum(1, keepdims=True) * base
        z /= np.linalg.norm(z, axis=1, keepdims=True)
        rows += list((cos * base + np.sqrt(1 - cos * cos) * z) * rng.uniform(0.1, 50, size=(n, 1)))
    centre = rng.normal(size=dim)
    rows += list(centre + rng.normal(size=(700, dim)) * 0.02 * np.linalg.norm(centre))
    rows += [rows[0]] * 40
    return np.array(rows, np.float32)


def plain_links(x, labels, t=lattice.THRESHOLD):
    u = x.astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    s = (u @ u.T >= t) & (labels[:, None] == labels[None])
    np.fill_diagonal(s, False)
    return s


def test_lattice_recall_and_exactness(spark):
    x = planted()
    labels = np.arange(len(x)) % 1                     # one label: the hardest case
    df = spark.createDataFrame([(i, v.tolist(), int(la)) for i, (v, la) in enumerate(zip(x, labels))],
                               "vec_id long, embedding array<float>, label int").repartition(5)
    got = {r.vec_id: r for r in lattice.near_duplicates(df).collect()}
    s = plain_links(x, labels)
    found, true = sum(r.n_links for r in got.values()), int(s.sum())
    assert len(got) == len(x) and 0.97 * true <= found <= true
    assert all(got[i].n_links <= s[i].sum() for i in got)
    roots = union_find(len(x), [(int(a), int(b)) for a, b in zip(*np.nonzero(np.triu(s)))])
    same = np.mean([got[i].component_id == roots[i] for i in got])
    assert same >= 0.95 and all(r.kept == (r.vec_id == r.component_id) for r in got.values())
    assert got[0].n_links >= 40                        # its copies


def test_lattice_on_the_small_table_equals_brute_force(spark):
    df = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    table = df.collect()
    s = plain_links(np.array([r.embedding for r in table], np.float32), np.array([r.label for r in table]))
    got = {r.vec_id: r.n_links for r in lattice.near_duplicates(df).collect()}
    assert sum(got.values()) >= 0.9 * s.sum() and all(got[r.vec_id] <= s[i].sum() for i, r in enumerate(table))


def test_lattice_odd_rows(spark):
    a = [1.0, 2.0, 3.0]
    rows = [(1, a, 1), (2, a, 1), (3, [2.0, 4.0, 6.0], 1), (4, a, 2), (5, a, None), (6, None, 1), (7, [0.0] * 3, 1),
            (8, [1.0, None, 2.0], 1), (9, [float("nan"), 1.0, 1.0], 1), (10, [float("inf"), 1.0, 1.0], 1), (11, [], 1),
            (12, [1.0, 2.0], 1), (1, a, 1), (None, a, 1), (13, [1e38, 2e38, 3e38], 1), (14, [1e-38, 2e-38, 3e-38], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("cid", F.lit("clash"))
    got = sorted(((r.vec_id, r.n_links, r.component_id) for r in lattice.near_duplicates(df).collect()), key=repr)
    linked = [(i, 6, 1) for i in (1, 1, 2, 3, 13, 14)] + [(None, 6, 1)]
    assert got == sorted(linked + [(i, 0, i) for i in (4, 5, 6, 7, 8, 9, 10, 11, 12)], key=repr)
    assert lattice.near_duplicates(df.limit(0)).count() == 0


# --- 8: packing --------------------------------------------------------------------------------

def check_packing(docs, pieces, sequence=packing.SEQUENCE):
    """Every id in exactly one piece; sequences gapless and full but the last."""
    t = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    want = {}
    for i, r in enumerate(docs):
        ids = np.array(t.encode(r.text or "", add_special_tokens=False).ids + [packing.END_ID], "<u4")
        want.setdefault(r.doc_id, []).append(ids)
    total = sum(len(x) for v in want.values() for x in v)
    assert sum(p.length for p in pieces) == total
    by_doc, by_seq = {}, {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_seq.setdefault(p.sequence_id, []).append(p)
    for d, copies in want.items():
        assert sum(p.length for p in by_doc[d]) == sum(map(len, copies))
        for p in by_doc[d]:
            parts = [x[p.start:p.start + p.length] for x in copies if len(x) == p.doc_tokens]
            assert any(zlib.crc32(x.tobytes()) == p.ids_crc32 for x in parts)
    assert sorted(by_seq) == list(range(-(-total // sequence)))
    for s, ps in by_seq.items():
        at = 0
        for p in sorted(ps, key=lambda p: p.offset):
            assert p.offset == at and p.length > 0
            at += p.length
        assert at == (sequence if s < len(by_seq) - 1 else total - sequence * (len(by_seq) - 1))


@pytest.mark.parametrize("sequence", [64, packing.SEQUENCE])
def test_packing_is_lossless(real, odd, sequence):
    for df in (real, odd):
        check_packing(df.collect(), packing.pack(df, sequence=sequence, window=16 * sequence).collect(), sequence)


def test_packing_empty(none):
    assert packing.pack(none).count() == 0


def replayed(queues, window, weights):
    """Deficit round-robin, window by window: (source, document) in the order of service."""
    heads = {s: 0 for s in queues}
    balance = {s: 0.0 for s in queues}
    out, w, whole = [], 0, sum(weights.values())
    while any(heads[s] < len(queues[s]) for s in queues):
        for s in sorted(queues, key=lambda s: (s is not None, s)):
            balance[s] += window * weights[s] / whole
            while balance[s] > 1e-6 and heads[s] < len(queues[s]):
                row, n = queues[s][heads[s]]
                out.append((w, s, row))
                balance[s] -= n
                heads[s] += 1
        w += 1
    return out


@pytest.mark.parametrize("targets", [None, {"a": 3.0, "b": 1.0, "c": 1.0}])
def test_schedule_equals_replayed_round_robin(spark, targets):
    rng = random.Random(6)
    rows = [(i, rng.choice("aaaabc"), rng.choice((1, 5, 20, 60, 400))) for i in range(400)]
    tokens = spark.createDataFrame(rows, "row long, source string, n long")
    got = sorted((r.place, r.row, r.window) for r in packing.schedule(tokens, 250, targets, segment_rows=30).collect())
    length = {r: n for r, _, n in rows}
    at = 0
    for place, row, _ in got:                          # gapless order
        assert place == at
        at += length[row]
    source = {r: s for r, s, _ in rows}
    queues = {s: [(r, length[r]) for _, r, _ in got if source[r] == s] for s in "abc"}
    weights = targets or {s: float(sum(n for _, n in queues[s])) for s in "abc"}
    assert [(w, source[r], r) for _, r, w in got] == replayed(queues, 250, weights)


@pytest.mark.parametrize("count", [900, 2_500, 1_200_000])
def test_running_sums_over_many_blocks(spark, count):
    """One, two and three levels of block sums: a block holds one key, then 1,000 blocks."""
    rows = spark.range(0, count, 1, 4).select(F.col("id").alias("k"), (F.col("id") % 7 + 1).alias("n"))
    out = packing._running_all(rows, ["k"], "n", "base", 1)
    assert out.columns == ["k", "n", "base"]
    # of 1..7 again and again: 28 in each whole round, then 1 + .. + (k mod 7)
    want = F.floor(F.col("k") / 7) * 28 + (F.col("k") % 7) * (F.col("k") % 7 + 1) / 2
    assert out.agg(F.count(F.lit(1)), F.countDistinct("k"), F.sum(F.when(F.col("base") == want, 1))).first() == (count,) * 3


def test_schedule_over_more_windows_than_two_levels_hold(spark):
    """17,000 windows, as of 1.1 billion tokens at the default window: more than 1,000 blocks of 16."""
    tokens = spark.range(0, 34_000, 1, 4).select(F.col("id").alias("row"), F.when(F.col("id") % 4 != 0, "a").alias("source"),
                                                 F.lit(8).cast("long").alias("n"))
    rows = sorted((r.place, r.row, r.window) for r in packing.schedule(tokens, 16).collect())
    assert [p for p, _, _ in rows] == list(range(0, 8 * 34_000, 8))      # gapless order
    assert sorted(r for _, r, _ in rows) == list(range(34_000))
    queues = {s: [(r, 8) for _, r, _ in rows if (r % 4 != 0) == (s == "a")] for s in (None, "a")}
    weights = {s: float(len(q)) for s, q in queues.items()}
    assert [(w, "a" if r % 4 else None, r) for _, r, w in rows] == replayed(queues, 16, weights)


def test_windows_hold_the_target_mixture(spark):
    rng = random.Random(7)
    rows = [(i, "hot" if i % 3 else f"s{i % 7}", rng.randint(1, 50)) for i in range(6000)]
    tokens = spark.createDataFrame(rows, "row long, source string, n long")
    total, hot = sum(r[2] for r in rows), sum(r[2] for r in rows if r[1] == "hot")
    out = packing.schedule(tokens, 2000, segment_rows=100).join(tokens, "row")
    shares = [r.h / r.n for r in out.groupBy("window").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("source") == "hot", F.col("n")).otherwise(0)).alias("h")).collect() if r.n > 1500]
    assert len(shares) > 50 and max(abs(s - hot / total) for s in shares) < 0.08


# --- 10: extraction ----------------------------------------------------------------------------

PAGE = ('<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body>'
        '<header class="top"><h1>Site name</h1></header><nav><ul><li><a href="/">Home page</a></li><li><a href="/b">About</a></li></ul></nav>'
        '<div class="cookie-notice"><p>We use cookies.</p></div><!-- a --><article><h1>Head &amp; line</h1><p>First   paragraph,\n with words.'
        '<p>Second one&nbsp;is <b>bold</b> &#169; here.<br>After.<ul><li>Point</ul><aside><p>Related posts</p></aside><p>Last paragraph.</p>'
        '<section class="comments"><p>Nice text, thanks!</p></section></article><form><label>Mail</label><input></form>'
        '<footer>&copy; site</footer></body></html>')
MAIN = "Head & line\n\nFirst paragraph, with words.\n\nSecond one is bold © here. After.\n\nPoint\n\nLast paragraph."


@pytest.fixture(scope="session")
def pages(spark):
    return spark.read.parquet(f"{SMALL}/pages.parquet")


@pytest.fixture(scope="session")
def trees(pages):
    return extract.fit(pages)


def test_parser_and_teacher():
    p = extract.Page(PAGE)
    assert p.text(p.teach()) == MAIN


def test_trees_agree_with_landmarks_on_all_pages(pages, trees):
    table = pages.collect()
    got = extract.extract_batch([r.html for r in table], trees)
    wrong = 0
    for r, (text, n) in zip(table, got):
        p = extract.Page(r.html)
        wrong += text != p.text(p.teach())
        assert n == len(text)
    assert wrong <= 0.01 * len(table)


def test_trees_on_unseen_forms(pages, trees):
    """Held-out changed pages: landmarks renamed, furniture added."""
    right = total = 0
    for r in pages.collect():
        source = extract.changed(r.html, 1000 + r.page_id)
        p = extract.Page(source)
        right += extract.extract_batch([source], trees)[0][0] == p.text(p.teach())
        total += 1
    assert right >= 0.8 * total


def test_decoding_is_consistent_and_optimal(trees):
    rng = np.random.default_rng(3)
    p = extract.Page("<div>a<div>b<p>c</p></div><p>d</p></div><p>e</p>")
    for _ in range(50):
        prob = rng.uniform(0.01, 0.99, len(p.tag))
        kept = p.decode(prob)
        assert all(kept[p.parent[v]] for v in range(1, len(kept)) if kept[v])
        weight = np.ones(len(kept))
        for node, text, _ in p.runs:
            weight[node] += len(text) ** 0.5

        def score(k):
            return (np.where(k, np.log(prob), np.log(1 - prob)) * weight)[1:].sum()
        best = max((score(k) for bits in range(1 << (len(kept) - 1))
                    for k in [np.array([True] + [bool(bits >> i & 1) for i in range(len(kept) - 1)])]
                    if all(k[p.parent[v]] for v in range(1, len(k)) if k[v])))
        assert abs(score(kept) - best) < 1e-9


def test_exported_trees_equal_mllib(spark, pages):
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector, vector_to_array
    parsed = [extract.Page(r.html) for r in pages.orderBy("page_id").limit(20).collect()]
    rows = [(k, [float(v) for v in x], float(y)) for k, (x, y) in enumerate(
        (x, y) for p in parsed for x, y in zip(p.features(), p.teach()))]
    nodes = spark.createDataFrame(rows, "k long, x array<double>, label double").withColumn("features", array_to_vector("x"))
    model = GBTClassifier(maxIter=6, maxDepth=extract.DEPTH, stepSize=0.3, seed=7).fit(nodes)
    want = [r.p for r in model.transform(nodes).select("k", vector_to_array("probability")[1].alias("p")).orderBy("k").collect()]
    ours = extract.Boosted([extract._arrays(t._java_obj.rootNode()) for t in model.trees], list(model.treeWeights))
    assert np.allclose(ours.probability(np.array([x for _, x, _ in rows])), want, atol=1e-9)
    assert min(want) < 0.2 and max(want) > 0.8


def test_sample_of_pages_ignores_copies_and_layout(spark, pages):
    distinct = {r.html for r in pages.collect() if r.html}
    one = pages.filter(F.length("html") > 0).orderBy("page_id").limit(1).select("html")
    copied = pages.select("html").unionByName(one.join(spark.range(3000)).select("html"))
    want = {r.html for r in extract.sample_pages(pages, train_pages=30).collect()}
    assert len(want) == min(30, len(distinct))
    for table in (copied.repartition(1), copied.repartition(7), copied.orderBy(F.desc("html"))):
        got = [r.html for r in extract.sample_pages(table, train_pages=30).collect()]
        assert len(got) == len(want) and set(got) == want
    assert extract.sample_pages(one.join(spark.range(500)).select("html")).count() == 1       # only copies: still a page
    assert extract.sample_pages(pages.limit(0)).count() == 0


def test_no_training_page_is_announced(pages):
    with pytest.warns(UserWarning, match="teacher"):
        assert extract.fit(pages.limit(0)) is None


def test_extraction_odd_rows(spark, trees):
    rows = [(1, None, "x"), (2, "", "x"), (3, PAGE, None), (3, PAGE, None), (4, "<p", "x"), (5, "plain text only &am", "x"),
            (6, "<div>" * 3000 + "deep", "x"), (None, "<article><p>" + "word " * 200_000 + "</article>", "x"),
            (7, "<script>never closed <p>x", "x"), (8, '<p class="unclosed>text</p>', "x")]
    df = spark.createDataFrame(rows, "page_id long, html string, text string")
    out = {r.page_id: r for r in extract.extract(df, model=trees, fitted=True).collect()}
    assert out[1].main.text == out[2].main.text == out[7].main.text == "" and out[1].main.n_chars == 0
    assert out[None].main.n_chars == 5 * 200_000 - 1 and out[1].text == "x"
    assert extract.extract(df.limit(0)).count() == 0
    untrained = extract.extract(df.filter("page_id = 3"), model=None, fitted=True).first()
    assert untrained.main.text == MAIN


# --- the pipeline --------------------------------------------------------------------------------

def test_stages_keep_columns_and_take_effect(spark, real, odd):
    docs = real.limit(120).unionByName(odd.drop("row").filter("doc_id is not null").withColumn("doc_id", F.col("doc_id") + 10 ** 6))
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SMALL).cache()
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns, name
            assert 0 < out.count() <= docs.count(), name
            docs = out
    check_packing(docs.collect(), out.collect())
    kept = {r.text for r in docs.collect()}
    assert not any("ann.b@mail.example.com" in t or t.startswith("To To To") or t == "12 34 !!! ***" for t in kept)
    assert sum(EN * 5 == t for t in kept) <= 1


def test_packing_stage_over_many_windows(spark, monkeypatch):
    """More than 16,000 windows, which the default window reaches at 1.05 billion tokens."""
    monkeypatch.setattr(packing, "pack", partial(packing.pack, window=2))
    docs = spark.range(0, 16_400, 1, 4).select(F.col("id").alias("doc_id"), F.lit("a").alias("text"), F.lit("en").alias("lang"),
                                               F.concat(F.lit("s"), F.col("id") % 3).alias("source"), F.lit(1).cast("long").alias("n_chars"))
    out = dict(corpus_pipeline.STAGES)["mixture_packing"](spark, docs, SMALL).cache()
    assert out.agg(F.max("window")).first()[0] >= 16_000
    check_packing(docs.collect(), out.collect())


def test_stages_on_an_empty_table(spark, none):
    docs = none.drop("row")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SMALL)
        assert out.columns == docs.columns and out.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).count() == 0


def test_run_equals_its_stages(spark):
    out = corpus_pipeline.run(spark, SMALL)
    assert out.columns[0] == "doc_id" and out.count() > 0
    assert isinstance(out.schema["length"].dataType, T.LongType)


@pytest.mark.parametrize("html, want", [
    ("<p>a</p><svg class='i' /><article>whole <b>article</b></article>", "a|whole article"),
    ("<p>a</p><svg><path/></svg><article>text</article>", "a|text"),
    ("<p>one <svg><svg><text>in</text></svg>rest</svg>two</p>", "one two"),
    ("<object>x<object>y</object>z</object><p>text</p>", "text"),
    ("<div><button>label<article>text</article></div><p>more</p>", "text|more"),
    ("<li><canvas>x</li><p>text</p><button>no</button>", "text"),
    ("<p>a</p><iframe src='x'/><p>b</p>", "a|b"),
    ("<p>a <button><div>label</div></button>b</p>", "a b"),
    ("<select><option>1<option>2</select><video><p>fallback</p></video><p>text</p>", "text"),
])
def test_hidden_elements_hide_only_what_they_hold(html, want):
    p = extract.Page(html)
    assert p.text(np.array(p.shown)).replace("\n\n", "|") == want
