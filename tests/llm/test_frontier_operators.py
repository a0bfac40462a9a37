"""Reply trees, spelling variants and simplex centroids against plain versions."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_fixtures import SMALL
from pyspark.sql import functions as F
from rivulet.llm import centroids, queries, replies, spelling


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# --- 11: reply trees ---------------------------------------------------------------------

PIECES = st.lists(st.sampled_from([*replies.CONTROL, "\\", "<", "[", "|im_start|>", "/s>", "INST]", "<SYS>>", "a", "\n", "é🙂"]),
                  max_size=12).map("".join)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(PIECES, PIECES), max_size=4))
def test_template_is_reversible_and_holds_no_control_string(turns):
    text, spans = replies.render(turns)
    assert list(replies.parse(text)) == turns
    assert [replies.unescape(text[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant"]
    for role, said in turns:
        for control in replies.CONTROL:
            assert control not in replies.escape(said)
    assert text.count(replies.START) == text.count(replies.STOP) == len(turns)


def plain_digest(turns):
    said = [(r or "", t or "") for r, t in turns]
    loss = "".join(t for r, t in said if r == "assistant")
    return len(said), sha("".join(f"{r}\n{t}\n" for r, t in said)), len(loss), sha(loss), len(replies.render(said)[0])


def digests(found):
    return sorted(((r.conv, r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256, r.formatted_chars)
                   for r in replies.read_back(found).collect()), key=repr)


def plain_chain(rows):
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv].append((turn, role, text))
    order = lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or "")       # noqa: E731
    return {c: [(r, t) for _, r, t in sorted(ts, key=order)] for c, ts in by.items()}


def test_conversations_by_turn_equal_plain_version(spark):
    rows = [(1, k, ["user", "assistant"][k % 2], f"text {k} </s>") for k in range(700)]           # several segments
    rows += [(2, 0, "user", None), (2, 1, "assistant", ""), (3, None, None, "x"), (3, 0, "assistant", "[INST]"),
             (None, 0, "user", "no id"), (None, 1, "assistant", "yes"), (4, 5, "assistant", "é🙂\n" * 40_000)]
    rows += [(5, 0, "user", "same")] * 3 + [(6, 0, "assistant", "only")]
    random.Random(1).shuffle(rows)
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn(
        "node", F.lit(1)).withColumn("conv", F.lit("clash")).withColumn("score", F.lit("x")).repartition(5)
    want = sorted(((c, *plain_digest(t)) for c, t in plain_chain(rows).items()), key=repr)
    found = replies.conversations(*replies.turn_chain(table))
    assert digests(found) == want
    assert {r.segments for r in found.filter("conv = 1").collect()} == {3}
    empty = table.limit(0)
    assert replies.read_back(replies.conversations(*replies.turn_chain(empty))).count() == 0


def plain_paths(rows):
    """All root-to-leaf paths per (conv, root) with their scores, best first."""
    first = {}
    for r in sorted(rows, key=lambda r: (r[2] is not None, r[2] or 0, r[3] or "", r[4] or "", r[5] or 0)):
        first.setdefault((r[0], r[1]), r)
    ids = sorted(first)
    up = {k: (k[0], first[k][2]) if (k[0], first[k][2]) in first else None for k in ids}
    for k in ids:                                                  # the least message of a cycle is a root
        seen, at = [], k
        while at is not None and at not in seen:
            seen.append(at)
            at = up[at]
        if at is not None:
            up[min(seen[seen.index(at):])] = None
    answered = set(up.values())
    trees = defaultdict(list)
    for leaf in ids:
        if leaf not in answered:
            path, at = [], leaf
            while at is not None:
                path.insert(0, at)
                at = up[at]
            trees[path[0]].append((-sum(first[p][5] or 0.0 for p in path), leaf, [first[p][3:5] for p in path]))
    return {root: sorted(paths, key=lambda p: p[:2]) for root, paths in trees.items()}


@pytest.mark.parametrize("keep", [1, 2, None])
def test_branches_of_trees_equal_plain_version(spark, keep):
    rng, rows = random.Random(7), []
    for conv in range(6):
        for m in range(40):
            parent = None if m == 0 else rng.randrange(m) if conv < 4 else m - 1              # two long threads
            rows.append((conv, m, parent, rng.choice(["user", "assistant"]), f"{conv}.{m}", rng.choice([0.0, 1.0, 0.5, None])))
    rows += [(7, 1, 3, "user", "a", 1.0), (7, 2, 1, "user", "b", 1.0), (7, 3, 2, "user", "c", 1.0),      # a cycle
             (7, 4, 2, "assistant", "d", 1.0), (8, 1, 1, "user", "itself", 1.0), (8, 2, 99, "user", "orphan", None),
             (9, 5, None, "user", "twice", 1.0), (9, 5, None, "user", "twice", 1.0)]
    table = spark.createDataFrame(rows, "conv_id long, message_id long, parent_id long, role string, text string, score double")
    links, tables = replies.climbs(replies.reply_tree(table)[1])
    found = replies.conversations(*replies.reply_tree(table), keep=keep)
    got = sorted((r.conv, r["rank"], round(r.score, 9), list(replies.parse(r.text))) for r in found.collect())
    want = sorted((root[0], k + 1, round(-p[0], 9), p[2]) for root, paths in plain_paths(rows).items()
                  for k, p in enumerate(paths[:keep]))
    assert got == want
    assert len(tables) <= 7                                       # logarithmic in the depth of 40


def test_query_of_conversations(spark):
    got = {r.conv_id: tuple(r)[1:] for r in queries.op11_reply_trees(spark, SMALL).collect()}
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got == {c: plain_digest(t) for c, t in plain_chain(rows + queries.PROBE).items()}


# --- 12: spelling variants -----------------------------------------------------------------

def plain_vocabulary(docs):
    count = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= 7:
                count[run] += 1
    return {w: n for w, n in count.items() if n >= 2}


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plain_variants(words):
    near = {a: [b for b in words if one_edit(a, b)] for a in words}
    form = {}
    for a in words:
        best = min(near[a], key=lambda b: (-words[b], b), default=None)
        form[a] = best if best is not None and words[best] >= 10 * words[a] else None

    def root(a):
        while form[a] is not None:
            a = form[a]
        return a
    return {a: (form[a], root(a), words[a], len(near[a]), words.get(form[a])) for a in words}


def as_variants(df):
    return {r.word: tuple(r[c] for c in ("form", "root", "n", "n_near", "form_n")) for r in df.collect()}


def test_spelling_equals_plain_version(real, odd, none):
    for df in (odd, real.limit(60)):
        df = df.sparkSession.createDataFrame(df.collect(), df.schema)
        words = plain_vocabulary([(r.doc_id, r.text) for r in df.collect()])
        assert as_variants(spelling.variants(df)) == plain_variants(words)
    assert spelling.variants(none).count() == 0


def test_frontier_finds_every_edit(spark):
    rng, words = random.Random(3), set()
    for _ in range(40):                                           # few letters: runs, ties, dense nodes
        w = "".join(rng.choice("abé") for _ in range(rng.randint(7, 12)))
        words.add(w)
        for _ in range(8):
            i, c = rng.randrange(len(w)), rng.choice("abézÿ")
            words.add(rng.choice([w[:i] + c + w[i:], w[:i] + w[i + 1:], w[:i] + c + w[i + 1:], w + c, c + w]))
    long = "".join(rng.choice("abcd") for _ in range(300))
    words |= {long, long[:150] + "z" + long[151:], long[:299], "b" + long, long[:7] + long[8:], "aaaaaaa", "aaaaaaaa", "aaaaaaaaa"}
    counts = {w: rng.choice([2, 2, 3, 20, 30, 200, 300, 3000]) for w in words if len(w) >= 7}
    table = spark.createDataFrame(list(counts.items()), "word string, n long")
    pairs = [(r.a, r.b) for r in spelling.near(table).collect()]
    want = {frozenset((a, b)) for a in counts for b in counts if one_edit(a, b)}
    assert len(pairs) == len(want) and {frozenset(p) for p in pairs} == want            # each once
    forms = spelling.forms(table, spelling.near(table))
    root = {r.word: r.root for r in spelling.roots(forms).collect()}
    plain = plain_variants(counts)
    assert {r.word: (r.form, root.get(r.word, r.word)) for r in forms.collect()} == {w: v[:2] for w, v in plain.items()}


# --- 13: simplex centroids -------------------------------------------------------------------

def plain_clusters(rows, k=40, rounds=5):
    rows = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in rows
            if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    x = np.array([v for _, v in rows], dtype=object).reshape(len(rows), 64)
    order = sorted(range(len(rows)), key=lambda j: (sha(f"2:{'' if rows[j][0] is None else rows[j][0]}"), rows[j][1]))[:k]
    centre = [list(rows[j][1]) for j in order]

    def assign():
        d = [[sum((a - b) ** 2 for a, b in zip(v, c)) for c in centre] for v in x]
        number = [min(range(len(centre)), key=lambda c: (row[c], c)) for row in d]
        return number, [row[c] for row, c in zip(d, number)]
    for _ in range(rounds):
        number, _ = assign()
        for c in range(len(centre)):
            mine = [v for v, n in zip(x, number) if n == c]
            if mine:
                centre[c] = [int(sum(col)) // len(mine) for col in zip(*mine)]
    number, dist = assign() if len(rows) else ([], [])
    total = Counter()
    for n, d in zip(number, dist):
        total[n] += int(d)
    return sorted(((i, n, int(d), total[n], int(sum(dist)), sha(",".join(map(str, centre[n]))))
                   for (i, _), n, d in zip(rows, number, dist)), key=repr)


def test_clusters_equal_plain_version(spark):
    rng = np.random.default_rng(5)
    tight = rng.normal(size=(6, 64))
    rows = [(i, (tight[i % 6] + 0.05 * rng.normal(size=64)).tolist()) for i in range(180)]
    rows += [(200 + i, rows[0][1]) for i in range(60)]                                     # copies
    rows += [(300, None), (301, [1.0] * 63), (302, [None] + [1.0] * 63), (303, [float("nan")] + [0.0] * 63),
             (304, [float("inf")] + [0.0] * 63), (305, [0.0] * 64), (None, [0.5] * 64), (7, rows[7][1]), (306, [-500000.0] * 64)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("cluster", F.lit("x")).withColumn("v", F.lit(0))
    got = sorted((tuple(r) for r in centroids.cluster(table.repartition(5)).collect()), key=repr)
    assert got == plain_clusters(rows)
    few = table.filter("vec_id < 3")
    assert sorted(tuple(r) for r in centroids.cluster(few).collect()) == plain_clusters([r for r in rows if r[0] is not None and r[0] < 3])
    assert centroids.cluster(table.limit(0)).count() == 0
    with pytest.raises(Exception, match="too large"):
        centroids.cluster(spark.createDataFrame([(1, [1e9] * 64)], "vec_id long, embedding array<double>")).count()


def test_bounds_enclose_distances():
    rng = np.random.default_rng(1)
    points = rng.integers(-200, 200, (40, 64))
    points[5] = points[4]
    x = np.concatenate([rng.integers(-300, 300, (300, 64)), points])
    simplex = centroids.Simplex(points)
    a, c = simplex.apexes(x), simplex.apexes(points)
    true = np.sqrt(((x[:, None] - points[None]) ** 2).sum(2))
    flat = ((a[:, None, :-1] - c[None, :, :-1]) ** 2).sum(2)
    assert (np.sqrt(flat + (a[:, None, -1] - c[None, :, -1]) ** 2) <= true + 1e-4).all()
    assert (np.sqrt(flat + (a[:, None, -1] + c[None, :, -1]) ** 2) >= true - 1e-4).all()
    assert centroids.candidates(a, c)[np.arange(len(x)), true.argmin(1)].all()
    near, full = points + rng.integers(-3, 4, points.shape), centroids.Simplex(points, 40)
    few = centroids.candidates(simplex.apexes(near), c).mean()
    most = centroids.candidates(full.apexes(near), full.apexes(points)).mean()
    assert most < 0.05 < few < 0.8                                     # more pivots leave fewer centroids
