"""Manifest, phrases and nearest neighbours against brute force, and on odd rows."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from voxelake.llm import collocations, fm_index, merkle, nearest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, node string, tree long, rank int"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def item(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def climbed(hashes):
    """Levels of a tree, leaves first."""
    levels = [hashes]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i : i + 8]) for i in range(0, len(levels[-1]), 8)])
    return levels


def siblings(levels, i):
    out = []
    for level in levels[:-1]:
        lo = i // 8 * 8
        out.append(("".join(level[lo:i]), "".join(level[i + 1 : lo + 8])))
        i //= 8
    return out


def brute_manifest(rows):
    by = defaultdict(list)
    for r in rows:
        doc_id, text, lang, source, n = r[:5]
        low = None if text is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
        hit = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 0
        a, b = (h(*map(item, (doc_id, source, lang, n, t))) for t in (text, low))
        by[lang].append((doc_id, a, b if hit else a))
    langs = sorted(by, key=lambda k: (k is not None, (k or "").encode()))
    trees = {}
    for k in langs:
        by[k].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees[k] = climbed([x[1] for x in by[k]])
    over = climbed([trees[k][-1][0] for k in langs])
    out = []
    for j, k in enumerate(langs):
        for i, (doc_id, a, b) in enumerate(by[k]):
            path = siblings(trees[k], i) + siblings(over, j)
            for before, after in path:
                b = h(before, b, after)
            out.append((doc_id, a, trees[k][-1][0], over[-1][0], h(*[x + y for x, y in path]), b, b == over[-1][0]))
    return sorted(out, key=str)


def odd_rows():
    rows = [(i, f"Text Number {i % 7}", "en", "s", i) for i in range(700)]  # more than one block
    rows += [(i, "x", "en", "s", 1) for i in (3, 3, 3)] + [(None, t, "en", None, None) for t in (None, "", "A", "A")]
    rows += [(1, None, None, None, None), (2, "", None, "s", 0), (5, "Ünï \U0001f600" * 9000, "de", "s", 7), (-4, "q", "", "s", 1)]
    rows += [(i, "Lang", f"l{i}", "s", 1) for i in range(70)]
    return [(*r, "n", 1, 2) for r in rows]


def test_manifest(spark):
    rows = odd_rows()
    df = merkle.report(spark.createDataFrame(rows, DOCS).repartition(5))
    assert df.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(tuple, df.collect()), key=str) == brute_manifest(rows)


@pytest.mark.parametrize("n", [0, 1, 8, 9, 65])
def test_manifest_sizes(spark, n):
    rows = [(i, "T", "en", "s", 1, "", 0, 0) for i in range(n)]
    got = merkle.report(spark.createDataFrame(rows, DOCS))
    assert sorted(map(tuple, got.collect()), key=str) == (brute_manifest(rows) if rows else [])


def test_manifest_in_many_passes(spark, monkeypatch):
    """Blocks of eight: several passes up and down."""
    monkeypatch.setattr(merkle, "DIGITS", 1)
    monkeypatch.setattr(merkle, "BLOCK", 8)
    rows = odd_rows()[:150]
    assert sorted(map(tuple, merkle.report(spark.createDataFrame(rows, DOCS)).collect()), key=str) == brute_manifest(rows)


def test_index_finds_all_phrases():
    rng = np.random.default_rng(3)
    for n in (1, 2, 40, 500):
        seq = np.concatenate([[0], rng.integers(0, 5, n), [1, 0]])
        index = fm_index.Index(seq)
        now = index.single()
        for size in range(1, fm_index.DEPTH + 1):
            want = Counter(tuple(int(c) for c in seq[i : i + size]) for i in range(len(seq) - size + 1) if 0 not in seq[i : i + size])
            now = now.where(now.size > 0)  # ids that don't occur
            assert {tuple(map(int, w)): int(c) for w, c in zip(now.words, now.size)} == want and len(now.size) == len(want)
            if size < fm_index.DEPTH:
                now = index.right(now) if size % 2 == 0 else index.left(now)
        for a, b in ((index.left, index.right), (index.right, index.left)):  # the order of steps doesn't matter
            p = b(a(index.single()))
            assert sum(p.size) == sum(Counter(tuple(seq[i : i + 3]) for i in range(len(seq) - 2) if 0 not in seq[i : i + 3]).values())


def brute_phrases(rows, least, top):
    counts = defaultdict(Counter)
    for _, text, lang, *_ in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            ws = re.findall(r"[^\x20\x09]+", piece)
            for k in range(1, 5):
                for i in range(len(ws) - k + 1):
                    counts[lang or "und"][tuple(ws[i : i + k])] += 1
    out = []
    for lang, c in counts.items():
        n = sum(v for k, v in c.items() if len(k) == 1)
        good = {k: v for k, v in c.items() if len(k) > 1 and v >= least}
        found = []
        for p, a in good.items():
            if any(len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q))) and 100 * b >= 80 * a for q, b in good.items()):
                continue
            score, k = min((2_000_000 * a // (c[p[:k]] + c[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n, -s))
    return sorted(out)


@pytest.mark.parametrize("held", [1 << 20, 0])
@pytest.mark.parametrize("shard", [collocations.SHARD_BYTES, 3000])
def test_phrases(spark, monkeypatch, held, shard):
    """Whether frequent words and pairs are sent or joined, and however texts fall into shards."""
    monkeypatch.setattr(collocations, "HELD_ROWS", held)
    monkeypatch.setattr(collocations, "SHARD_BYTES", shard)
    rng = np.random.default_rng(5)
    vocabulary = ["Alpha", "beta", "été", "b c", "d\u0000e", "x-y", "(z)", "\U0001f600"]
    rows = []
    for i in range(120):
        words = rng.choice(vocabulary, rng.integers(0, 60), p=[0.3, 0.3, 0.1, 0.1, 0.05, 0.05, 0.05, 0.05])
        text = "".join(w + str(rng.choice([" ", "\t", " ", " ", ". ", ",", "\n", "  "])) for w in words)
        rows.append((i, text + " one two three four", [None, "und", "en", "de"][i % 4], "s", 1, "", 0, 0))
    rows += [(1, None, "en", "s", 0, "", 0, 0), (2, "", None, "s", 0, "", 0, 0), (3, " .,", "fr", "s", 0, "", 0, 0), (4, "deep " * 30000, "en", "s", 0, "", 0, 0)] + [rows[5]] * 20
    got = collocations.report(spark.createDataFrame(rows, DOCS).repartition(3), least=6, top=15)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == brute_phrases(rows, 6, 15)


def test_held_keys(spark, monkeypatch):
    """Every key is found again and hardly another, and the table has its bound, however many keys there are."""
    rng = np.random.default_rng(8)
    keys = rng.integers(-(1 << 63), 1 << 63, 40000)
    table = spark.createDataFrame([(int(k),) for k in keys], "key long").repartition(3)
    held = collocations.Held(table)
    assert held.has(keys).all() and held.has(rng.integers(-(1 << 63), 1 << 63, 40000)).mean() < 0.02
    monkeypatch.setattr(collocations, "HELD_ROWS", 1 << 12)
    held = collocations.Held(table)
    assert held.has(keys).all() and held.sent.value.nbytes == (1 << 12) * collocations.KEY_BITS // 8
    assert not collocations.Held(table.limit(0)).has(keys).any()


@pytest.mark.parametrize("held", [1 << 20, 0])
def test_shards_meet_no_lists(spark, monkeypatch, held):
    """However many words and pairs are frequent, none are gathered for a shard in the executors' memory: shards go to tasks as they are stored."""
    monkeypatch.setattr(collocations, "HELD_ROWS", held)
    plans = []
    each = collocations._each
    monkeypatch.setattr(collocations, "_each", lambda rows, *rest: (plans.append(rows._jdf.queryExecution().toString()), each(rows, *rest))[1])
    words, phrases = collocations.counted(spark.createDataFrame([(i, "a b c a b", "en", "s", 1, "", 0, 0) for i in range(40)], DOCS))
    assert {(r.phrase, r.a) for r in phrases.collect()} == {("a b", 80), ("b c", 40), ("c a", 40), ("a b c", 40), ("b c a", 40), ("c a b", 40), ("a b c a", 40), ("b c a b", 40)}
    assert len(plans) == 2 and not any("Join" in p or "collect_set" in p for p in plans)


def test_phrases_of_nothing(spark):
    assert collocations.report(spark.createDataFrame([], DOCS)).count() == 0
    assert collocations.report(spark.createDataFrame([(1, "a b", "en", "s", 1, "", 0, 0)], DOCS)).count() == 0


VECTORS = "vec_id long, embedding array<float>, label int, v string, leaf int, key int"


def brute_nearest(rows, k=5):
    good = [(i, np.array(v, np.float64)) for i, v, *_ in rows if i is not None and v is not None and all(c is not None and np.isfinite(c) for c in v) and any(v)]
    length = Counter(len(v) for _, v in good).most_common(1)[0][0]
    good = [(i, v) for i, v in good if len(v) == length]
    out = set()
    for q, a in good:
        if q % 50 == 0:
            near = sorted({(-float(round((a * b).sum() / (np.sqrt((a * a).sum()) * np.sqrt((b * b).sum())), 12)), i) for i, b in good if i != q})[:k]
            out |= {(q, r, i, -s) for r, (s, i) in enumerate(near, 1)}
    return sorted(out)


def rounded(df):
    return sorted((r.query_id, r["rank"], r.vec_id, round(r.score, 12)) for r in df.collect())


def test_nearest_on_odd_rows(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.standard_normal(4).astype(np.float32)]) for i in range(120)]
    rows += [(i, [1.0, 2.0, 3.0, 4.0]) for i in range(200, 240)] + [(250, [1.0, 2.0, 3.0, 4.0]), (300, [1.0, 2.0, 3.0, 4.0]), (301, [2.0, 4.0, 6.0, 8.0])]
    rows += [(350, None), (400, []), (450, [0.0] * 4), (500, [1.0, None, 2.0, 3.0]), (550, [1.0, float("nan"), 0.0, 0.0]), (600, [float("inf"), 1.0, 1.0, 1.0]), (650, [1.0, 2.0]), (None, [1.0, 1.0, 1.0, 1.0])]
    rows += [(700, [1e38, 1e38, 1e-38, 0.0])] + [(50, rows[50][1])] * 3
    df = spark.createDataFrame([(*r, 0, "x", 1, 2) for r in rows], VECTORS).repartition(5)
    got = rounded(nearest.report(df))
    assert {r[0] for r in got} == {0, 50, 100, 200, 250, 300, 700}
    assert got == brute_nearest([(r.vec_id, r.embedding) for r in df.collect()])


def test_few_vectors(spark):
    assert nearest.report(spark.createDataFrame([], VECTORS)).count() == 0
    two = spark.createDataFrame([(0, [1.0, 0.0], 0, "", 0, 0), (50, [0.0, 1.0], 0, "", 0, 0)], VECTORS)
    assert rounded(nearest.report(two)) == [(0, 1, 50, 0.0), (50, 1, 0, 0.0)]
    assert nearest.report(two.where("vec_id = 0")).count() == 0


@pytest.mark.parametrize("clusters", [0, 40])
def test_recall_of_the_forest(spark, monkeypatch, clusters):
    """Random vectors, and clusters with a third of all rows in one and many equal ones; leaves and queries in several blocks."""
    monkeypatch.setattr(nearest, "LEAF_ROWS", 128)
    monkeypatch.setattr(nearest, "SAMPLE", 1500)
    monkeypatch.setattr(nearest, "BLOCK", 50)
    rng = np.random.default_rng(clusters)
    x = rng.standard_normal((4000, 16))
    if clusters:
        centre = rng.standard_normal((clusters, 16)) * 4
        x = x + centre[np.where(rng.random(4000) < 0.33, 0, rng.integers(0, clusters, 4000))]
        x[::7] = x[0]
    x = x.astype(np.float32)
    df = spark.createDataFrame([(i, [float(c) for c in v], 0, "", 0, 0) for i, v in enumerate(x)], VECTORS)
    got = rounded(nearest.report(df))
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1)[:, None]
    hit = 0
    for q in range(0, 4000, 50):
        near = np.round(u @ u[q], 12)
        near[q] = -2
        want = np.lexsort((np.arange(4000), -near))[:5]
        own = [r for r in got if r[0] == q]
        assert [r[1] for r in own] == [1, 2, 3, 4, 5] and own == sorted(own, key=lambda r: (-r[3], r[2]))
        hit += len({r[2] for r in own} & set(want))
    assert hit >= 0.9 * 400


def test_queue_takes_leaves_by_distance():
    """With a budget of all leaves each is met once; the order is that of the farthest plane crossed."""
    rng = np.random.default_rng(1)
    x = nearest.unit(rng.standard_normal((400, 8)))
    forest = nearest.fit(x, 16, trees=3)
    home = forest.place(x)
    assert home.shape == (400, 3) and (home // 16 == np.arange(3)).all()
    assert np.bincount(home[:, 0], minlength=16).min() >= 24  # medians
    for q, order in enumerate(forest.visits(x[:20], 48)):
        assert sorted(order) == list(range(48)) and {order.index(v) for v in home[q]} == {0, 1, 2}
        assert forest.visits(x[q : q + 1], 7)[0] == order[:7]
