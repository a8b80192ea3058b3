"""Every operator against brute force, and on nulls, empty and long texts, ties, repeats, empty tables and clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import tokenizers
from conftest import SF, same_rows
from pyspark.sql import functions as F

from voxelake.llm import bpe, chat_format, common, components, decontaminate, language_id, near_dup, quality, queries, subwords, suffix_dedup, suffix_group, token_counts, toxicity, trees, url_filter
from voxelake.llm.common import RESULT

CLASH = ("k0", "result__", "size", "set", "a", "tag", "doc", "h", "score", "text__", "key", "links")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
rng = random.Random(7)
WORDS = ["".join(rng.choice("abcdeßé") for _ in range(rng.randint(2, 7))) for _ in range(300)]


def prose(n, r=rng):
    return " ".join(r.choice(WORDS) for _ in range(n))


def corpus():
    r = random.Random(3)
    base = [prose(120, r) for _ in range(12)]
    shared = prose(40, r)
    texts = [None, "", "   \n", "one", "Ünï çode 😀 text", prose(30000, r), *base, *base[:4]]
    for b in base[:6]:
        w = b.split()
        w[60] = "changed"
        texts.append(" ".join(w))
    texts += [prose(20, r) + " " + shared + " " + prose(20, r) for _ in range(8)]
    texts += ["ab" * 400, "ab" * 300 + "c", base[0] * 3]
    rows = [(i, t, ("en", "de", None)[i % 3], f"s{i % 2}", None if t is None else len(t)) for i, t in enumerate(texts)]
    return rows + [rows[7], rows[0], (None, base[1], None, None, 5)]


def clashing(df):
    return df.withColumns({c: F.lit(c) for c in CLASH})


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words7(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


# 1


def test_token_counts_follow_any_history(spark, tmp_path):
    book = token_counts.Rollup(spark, str(tmp_path / "book"))
    r, want = random.Random(1), defaultdict(lambda: [0, 0])
    for b in range(5):
        rows = []
        for _ in range(40):
            kind = r.choice(["insert", "delete", "revise"])
            k = (r.choice(["s", None]), r.choice(["en", "de"]), "v1")
            n, old = r.choice([None, 3, 10]), r.choice([None, 4])
            rows.append((kind, *k, n, old))
            want[k][0] += {"insert": 1, "delete": -1, "revise": 0}[kind]
            want[k][1] += {"insert": n or 0, "delete": -(n or 0), "revise": (n or 0) - (old or 0)}[kind]
        df = spark.createDataFrame(rows, token_counts.CHANGES)
        assert book.commit(str(b), df) and not book.commit(str(b), df)
        if b == 2:
            book.compact()
            assert not book.commit("1", df)
    book.compact()
    assert not book.commit("4", df)
    assert book.commit("empty", spark.createDataFrame([], token_counts.CHANGES))
    got = {(x.source, x.lang, x.version): [x.n_docs, x.n_tokens] for x in book.totals().collect()}
    assert got == {k: v for k, v in want.items() if v != [0, 0]}
    with pytest.raises(Exception, match="unknown kind"):
        book.commit("bad", spark.createDataFrame([("move", "s", "en", "v", 1, None)], token_counts.CHANGES))
    assert token_counts.Rollup(spark, str(tmp_path / "none")).totals().count() == 0


def test_token_counts_count_once_whatever_meets(spark, tmp_path):
    def batch(n):
        return spark.createDataFrame([("insert", "s", "en", "v", n, None)], token_counts.CHANGES)

    def total(book):
        return [(r.n_docs, r.n_tokens) for r in book.totals().collect()]

    path = str(tmp_path / "meet")
    book, other = token_counts.Rollup(spark, path), token_counts.Rollup(spark, path)
    book.commit("a/*{1}", batch(10))
    book.commit("b", batch(20))
    # a commit between the list and the fold
    seen = book.snapshot()
    assert other.commit("c", batch(100))
    assert book.compact(seen) and total(book) == [(3, 130)]
    # two compactions at once, from the same list
    assert other.commit("d", batch(1))
    seen = other.snapshot()
    assert book.compact(seen) and not other.compact(seen)
    assert total(book) == total(other) == [(4, 131)]
    # covered ids stay known, also of the fold before
    assert not any(book.commit(k, batch(7)) for k in ("a/*{1}", "b", "c", "d"))
    book.clean()
    assert total(book) == [(4, 131)] and not book.compact()
    # a commit that was cut off before its file was there doesn't count, and can be sent again
    made = book._write(token_counts.signed(batch(50)))
    name = token_counts._file_name("e")
    book.folder.publish(f"pending/{name}.{made}", {})
    (tmp_path / "meet" / "commits" / f".{name}.0").write_text('{"id": "e", "da')
    assert total(book) == [(4, 131)] and book.commit("e", batch(5)) and not book.commit("e", batch(5))
    assert total(book) == [(5, 136)]
    # the mark of an attempt that lost, left after its batch was folded
    assert book.compact() and total(book) == [(5, 136)]
    book.folder.publish(f"pending/{token_counts._file_name('a/*{1}')}.{made}", {})
    assert total(book) == [(5, 136)] and not book.compact()
    # a fold whose marks were not cleared: they don't count beside it, nor with the next one
    assert other.commit("f", batch(1))
    drop, book.folder.drop = book.folder.drop, lambda name="": None
    assert book.compact() and total(other) == [(6, 137)]
    book.folder.drop = drop
    assert other.commit("g", batch(1)) and other.compact() and total(book) == [(7, 138)]
    book.clean()
    assert total(book) == [(7, 138)] and len(book.folder.names("data")) == 1


def test_token_counts_read_what_came_since_the_last_fold(spark, tmp_path):
    """However many batches and folds there were."""
    book = token_counts.Rollup(spark, str(tmp_path / "long"))
    for i in range(7):
        book.commit(str(i), spark.createDataFrame([("insert", "s", "en", "v", 1, None)], token_counts.CHANGES))
        if i % 2:
            book.compact()
    read, seen = type(book.folder).read, []
    book.folder.read = lambda name: seen.append(name) or read(book.folder, name)
    assert [(r.n_docs, r.n_tokens) for r in book.totals().collect()] == [(7, 7)]
    assert seen == ["folds/000000003", f"commits/{token_counts._file_name('6')}"]


def test_token_counts_of_the_real_tokenizer(spark, docs):
    """The rollup of the byte-pair version holds what op3 counts, before and after a revision."""
    counts = token_counts.bpe_counts(docs)
    want = sum(r.n_tokens for r in bpe.report(docs).collect())
    book = token_counts.Rollup(spark, common.work_dir(spark, "real"))
    n = F.col("n_tokens")
    book.commit("1", token_counts.changes(counts, "insert", token_counts.BPE_VERSION, n))
    assert want > 0 and sum(r.n_tokens for r in book.totals().collect()) == want
    book.commit("2", token_counts.changes(counts, "revise", token_counts.BPE_VERSION, n * 2, n))
    got = {(r.source, r.lang): r.n_docs for r in book.totals().collect()}
    assert got == Counter((x[3], x[2]) for x in corpus())
    assert sum(r.n_tokens for r in book.totals().collect()) == 2 * want


def test_token_counts_report(spark, docs):
    """Against the library's tokens, words and bytes of each text."""
    encoder = tokenizers.Tokenizer.from_file(bpe.default_path())
    encoder.no_truncation()
    encoder.no_padding()
    want = defaultdict(lambda: [0, 0])
    for _, text, lang, source, *_ in corpus():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
        if words:
            for version, n in ((token_counts.BPE_VERSION, len(encoder.encode(text, add_special_tokens=False).ids)), ("words-1", words), ("bytes-1", len(text.encode()))):
                for k in ((3, source, lang, version), (2, source, lang, None), (1, source, None, None), (0, None, None, None)):
                    want[k][0] += 1
                    want[k][1] += n
    got = sorted(((r.level, r.source, r.lang, r.version, r.n_docs, r.n_tokens) for r in token_counts.report(clashing(docs)).collect()), key=str)
    assert got == sorted(((*k, *v) for k, v in want.items()), key=str)
    assert token_counts.report(empty(spark)).where("n_docs > 0").count() == 0


# 2


def test_components(spark):
    r = random.Random(2)
    pairs = [(r.randrange(200), r.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 420)] + [(5, 5)]
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in pairs:
        if a != b:
            x, y = root(a), root(b)
            up[max(x, y)] = min(x, y)
    got = {x.node: x.component for x in components.components(spark.createDataFrame(pairs, "src long, dst long")).collect()}
    assert got == {x: root(x) for x in up}


def test_url_filter(spark):
    rows = [
        (1, "http://example.com/en/1", None), (2, "HTTP://A.EXAMPLE.com/en/7/x", ""), (3, "http://alias.org/x", '<link rel="canonical" href="http://example.com/en/1">'),
        (4, "http://other.org/y", '<meta http-equiv="refresh" content="0; url=http://alias.org/x">'), (5, None, "x"), (6, "nothing", None), (7, "http://example.net/de/8?q#f", None),
        (8, "http://example.com/en/7", '<link rel=canonical href="http://example.com/en/1">'), (9, "http://notcom/en/", None), (1, "http://example.com/en/1", None), (10, "https://q.net/de/9", "<LINK REL=canonical HREF=//other.org/y>"),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit(1) for c in ("host", "path", "rule", "verdict", "node", "component")})
    got = sorted((r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(df).collect())
    assert [(g[0], g[3], g[4]) for g in got] == [
        (1, "com/en/", "block"), (1, "com/en/", "block"), (2, "example.com/en/7", "allow"), (3, None, "block"), (4, None, "block"), (5, None, "allow"), (6, None, "allow"),
        (7, "example.net/de/8", "block"), (8, "example.com/en/7", "allow"), (9, None, "allow"), (10, "net/de/", "allow"),
    ]
    assert got[5][1:3] == ("", "") and got[2][1] == "a.example.com"
    assert url_filter.judge(df.limit(0)).count() == 0
    many = [(f"h{i}.com", "/", "block") for i in range(100)] + [("com", "/en/", "block"), ("example.com", "/en/7", "allow")]
    few = {(r.page_id, r.rule) for r in url_filter.judge(df, many).collect()}
    assert (1, "com/en/") in few and (2, "example.com/en/7") in few and (9, None) in few


def test_redirects_against_union_find(spark):
    """Some thousands of pages whose links take every form, against plain Python; one hub is named by a third of them."""
    from html import escape
    from urllib.parse import urljoin, urlsplit

    r = random.Random(22)
    hosts = ["a.com", "www.example.com", "b.net", "c.org", "Shop.Example.NET"]
    urls = [f"http://{r.choice(hosts)}/{r.choice(['en', 'de', 'es', 'x'])}/{r.choice(['p', 'q/r', '7'])}/{i}.html" + r.choice(["", "", "?k=1&l=2"]) for i in range(3000)]
    pages, links = [], []
    for i, u in enumerate(urls):
        kind = r.randrange(9)
        t = urlsplit(r.choice(urls[max(0, i - 3) : i + 1]) if kind < 6 else urls[0])
        tail = t.path + (f"?{t.query}" if t.query else "")
        to = [t.geturl(), f"//{t.netloc}{tail}", tail, "../" + tail.rsplit("/", 1)[1], "./" + str(r.randrange(3000)) + ".html", "?k=1&l=2", urls[0], urls[0] + "#top", r.choice(["#x", "mailto:me@a.com", "javascript:void(0)", ""])][kind]
        tag = f'<link rel="canonical" href="{escape(to)}">' if r.random() < 0.7 else f"<META http-equiv=refresh content='0; URL={escape(to)}'>"
        linked = r.random() < 0.6
        pages.append((i, u, f"<html><head>{tag if linked else ''}</head></html>"))
        if linked and to and not to.startswith(("#", "mailto", "javascript")):
            links.append((u, urljoin(u, to)))

    def node(u):
        s = urlsplit(u)
        return s.netloc.lower() + (s.path or "/") + (f"?{s.query}" if s.query else "")

    def rule(n):
        host, path = n.split("?")[0].split("/", 1)
        fits = [(len(h + p), v) for h, p, v in url_filter.RULES if (host == h or host.endswith("." + h)) and ("/" + path).startswith(p)]
        return max(fits)[1] if fits else None

    up = {}

    def root(x):
        up.setdefault(x, x)
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    for a, b in links:
        up[root(node(a))] = root(node(b))
    bad = {root(n) for n in list(up) if rule(n) == "block"}
    want = {i: rule(node(u)) or ("block" if node(u) in up and root(node(u)) in bad else "allow") for i, u, _ in pages}
    got = {x.page_id: x.verdict for x in url_filter.judge(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got == want
    passed_on = [i for i, u, _ in pages if want[i] == "block" and rule(node(u)) is None]
    assert len(passed_on) > 50 and len(links) > 1000


# 3


def test_bpe_equals_the_library(spark, docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.default_path())
    t.no_truncation()
    t.no_padding()
    codec = bpe.Codec(bpe.Vocabulary(bpe.default_path()))
    r = random.Random(5)
    strange = ["", " ", "\x85\x1c ᠎　x", "<|endoftext|>a <|endoftext|><|endoftext|>", "a" * 3000, "don't I'LL we've", "１２３ ½ ﬁ", "👩‍👩‍👧 é é", "\r\n\t  x  "]
    strange += ["".join(chr(r.choice([r.randrange(32, 127), r.randrange(160, 0x2FF), r.randrange(0x3000, 0x9FFF), r.randrange(0x1F300, 0x1F6FF), 10, 32])) for _ in range(60)) for _ in range(100)]
    for s in strange:
        want = t.encode(s, add_special_tokens=False).ids
        assert codec.encode(s) == want
        assert codec.decode(want).decode() == t.decode(want, skip_special_tokens=False)
    got = bpe.report(clashing(docs)).collect()
    texts = Counter((x[0], hashlib.sha256((x[1] or "").encode()).hexdigest()) for x in corpus())
    assert Counter((g.doc_id, g.decoded_sha256) for g in got) == texts
    ids = bpe.annotate(docs.where("doc_id = 4"), bpe.default_path()).select(f"{RESULT}.ids")
    assert bpe.decode_ids(ids, bpe.default_path()).first().decoded == "Ünï çode 😀 text"
    assert bpe.report(empty(spark)).count() == 0


# 4 and 9


def held(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def test_toxicity_on_held_out_misspellings(spark):
    r = random.Random(4)
    bad = ["idiotic", "worthless", "disgusting", "pathetic"]
    rows = []
    for i in range(700):
        w = [r.choice(WORDS) for _ in range(r.randint(10, 80))]
        toxic = i % 3 == 0
        if toxic:
            for _ in range(2):
                b = list(r.choice(bad))
                if r.random() < 0.4:
                    b[r.randrange(1, len(b))] = r.choice("xyz*")
                w[r.randrange(len(w))] = "".join(b)
        rows.append((i, " ".join(w), "en", "s", 1, int(toxic)))
    all_ = spark.createDataFrame(rows, SCHEMA + ", y int")
    docs = all_.drop("y").union(spark.createDataFrame([(9001, None, None, None, 0), (9002, "", None, None, 0), (9003, prose(5000), None, None, 0)], SCHEMA))
    labels = all_.select("doc_id", F.lit(1).alias("quality"), F.col("y").alias("toxic")).union(spark.createDataFrame([(1, 1, None), (9002, 1, 5)], "doc_id long, quality int, toxic int"))
    got = {x.doc_id: x for x in toxicity.report(clashing(docs), labels).collect()}
    assert len(got) == 703 and all(0 <= x.score <= 1 and x.predicted == int(x.score >= 0.5) and x.held_out == held(x.doc_id) for x in got.values())
    right = [got[i].predicted == y for i, *_, y in rows if held(i)]
    assert np.mean(right) > 0.95
    assert got[9001].predicted == got[9002].predicted == 0
    kept = toxicity.remove_toxic(clashing(docs), labels)
    assert kept.columns == clashing(docs).columns and {x.doc_id for x in kept.collect()} == {i for i, x in got.items() if not x.predicted}
    assert {x.score for x in toxicity.report(docs, labels.limit(0)).collect()} == {0.0}
    assert toxicity.report(docs.limit(0), labels).count() == 0


def test_labels_are_learned_only_outside_the_held_out_part(spark):
    docs = spark.createDataFrame([(i, prose(20) + (" moron" if i % 2 else ""), "en" if i % 2 else "de", "s", 1) for i in range(300)], SCHEMA)
    labels = docs.select("doc_id", F.lit(1).alias("quality"), (F.col("doc_id") % 2).cast("int").alias("toxic"))
    held_ids = [i for i in range(300) if held(i)]
    turned = labels.withColumn("toxic", F.when(F.col("doc_id").isin(held_ids), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    score = lambda ls: {r.doc_id: r.score for r in toxicity.report(docs, ls).collect()}
    assert score(labels) == score(turned)
    other = docs.withColumn("lang", F.when(F.col("doc_id").isin(held_ids), "fr").otherwise(F.col("lang")))
    langs = lambda d: {r.doc_id: (r.lang_pred, r.score) for r in language_id.report(d).collect()}
    assert langs(docs) == langs(other)


def test_language_id(spark):
    r = random.Random(9)
    vocab = {k: ["".join(r.choice(s) for _ in range(r.randint(2, 8))) for _ in range(200)] for k, s in (("aa", "abcdefgh"), ("bb", "ijklmnoé"), ("cc", "pqrstuvw"))}
    rows = [(i, " ".join(r.choice(vocab[k]) for _ in range(r.randint(3, 60))), k, "s", 1) for i in range(400) for k in [("aa", "bb", "cc")[i % 3]]]
    rows += [(1000, None, "aa", None, None), (1001, "12 34 --- 😀", "aa", None, None), (1002, "", None, None, None), (1003, "日本", None, None, None), (1004, " ".join(vocab["bb"] * 200), None, None, None)]
    got = {x.doc_id: x for x in language_id.report(clashing(spark.createDataFrame(rows, SCHEMA))).collect()}
    assert np.mean([got[i].lang_pred == k for i, _, k, *_ in rows[:400] if held(i)]) > 0.97
    assert [got[i].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3 and got[1003].lang_pred in vocab and got[1004].lang_pred == "bb"
    assert all(0 <= x.score <= 1 for x in got.values())
    assert {x.lang_pred for x in language_id.report(spark.createDataFrame([(1, "abc", None, None, 1)], SCHEMA)).collect()} == {"und"}
    assert language_id.report(empty(spark)).count() == 0


def test_forward_backward_sums_over_all_paths():
    r = np.random.default_rng(1)
    score, trans, start = r.normal(size=(1, 4, 3)), r.normal(size=(3, 3)), r.normal(size=3)
    total, marg = 0, np.zeros((4, 3))
    for path in np.ndindex(3, 3, 3, 3):
        p = np.exp(start[path[0]] + sum(score[0, t, path[t]] for t in range(4)) + sum(trans[path[t], path[t + 1]] for t in range(3)))
        total += p
        for t in range(4):
            marg[t, path[t]] += p
    got, _ = language_id.forward_backward(score, np.array([4]), trans, start)
    assert np.allclose(got[0], marg / total)


def test_blocks_of_words_are_one_chain():
    r = np.random.default_rng(4)
    size = [1, 31, 32, 33, 64, 65, 200, 5]
    text = np.repeat(np.arange(len(size)), size)
    score, trans, start = r.normal(size=(len(text), 3)) * 3, r.normal(size=(3, 3)) * 3, r.normal(size=3)
    first, length = language_id.blocks_of(text, len(size))
    at, inside = language_id.padded(np.arange(len(text)), first, length)
    left, right = language_id.messages(score[at], length, text[first], trans, start)
    got = language_id.forward_backward(score[at], length, trans, start, left=left, right=right)[0][inside]
    for i, n in enumerate(size):
        want, _ = language_id.forward_backward(score[text == i][None], np.array([n]), trans, start)
        assert np.allclose(got[text == i], want[0])


def test_language_scores_of_a_fixed_model(spark):
    """The operator against a plain chain of Python floats, on a text whose language changes at word 33."""
    r = random.Random(9)
    vocab = {k: ["".join(r.choice(s) for _ in range(r.randint(3, 8))) for _ in range(80)] for k, s in (("aa", "abcdefgh"), ("bb", "ijklmnop"))}
    say = lambda k, n: " ".join(r.choice(vocab[k]) for _ in range(n))
    learn = [(say(k, 40), k) for _ in range(60) for k in ("aa", "bb")]
    data, off = common.utf8(common.pa.array([t for t, _ in learn]))
    m = language_id.fit(data, off, [k for _, k in learn])
    texts = [say("aa", 32) + " " + say("bb", 45), say("bb", 100), say("aa", 1), ""]
    found = language_id.annotate(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), m).orderBy("doc_id").collect()
    assert (found[0][RESULT].run_ends, found[0][RESULT].run_langs) == ([32, 77], ["aa", "bb"])
    for t, row in zip(texts[:3], found):
        data, off = common.utf8(common.pa.array([t]))
        w = language_id.words_of(data, off, language_id.LETTERS)
        score = language_id.potentials(w, m)[w.kind]
        n, k = score.shape
        alpha, beta = [np.exp(m.start + score[0])], [np.ones(k)]
        for x in score[1:]:
            v = (alpha[-1] @ np.exp(m.transition)) * np.exp(x)
            alpha.append(v / v.sum())
        for x in score[:0:-1]:
            v = np.exp(m.transition) @ (np.exp(x) * beta[-1])
            beta.append(v / v.sum())
        both = np.array(alpha) * np.array(beta[::-1])
        mean = (both / both.sum(1, keepdims=True)).mean(0)
        assert row[RESULT].lang_pred == m.langs[mean.argmax()] and abs(row[RESULT].score - mean.max()) < 1e-4


def test_toxicity_scores_of_a_fixed_model(spark):
    """The operator against windows taken one by one."""
    r = random.Random(6)
    texts = [prose(n, r) for n in (0, 1, 2, 3, 4, 50, 400)]
    m = toxicity.Model(np.random.default_rng(2).normal(size=toxicity.BUCKETS), -0.3)
    got = {x.doc_id: x[RESULT].score for x in toxicity.annotate(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), m).collect()}

    def word(w):
        data, off = common.utf8(common.pa.array([w]))
        return toxicity.word_scores(toxicity.words_of(data, off, toxicity.WORD_BYTES), m)[0]

    for i, t in enumerate(texts):
        each = [word(w) for w in words7(t)]
        windows = [each[j : j + 3] for j in range(max(1, len(each) - 2))] if each else [[0.0]]
        z = max(sum(x) / len(x) for x in windows) + m.bias
        assert abs(got[i] - 1 / (1 + np.exp(-z))) < 1e-9


def test_words_in_pieces(monkeypatch):
    r = random.Random(17)
    data, off = common.utf8(common.pa.array([prose(r.randrange(40), r) for _ in range(200)] + ["x" * 3000, "", prose(500, r)]))
    whole = subwords.words_of(data, off, toxicity.WORD_BYTES)
    monkeypatch.setattr(subwords, "PIECE", 700)
    parts = subwords.words_of(data, off, toxicity.WORD_BYTES)
    assert all((getattr(whole, k) == getattr(parts, k)).all() for k in ("kind", "text", "hashes", "framed", "off"))


def test_fits_are_bounded_when_an_id_is_repeated(spark):
    """An id that holds a third of all rows gives one text; texts of any length may be learned from."""
    hot = [(5, prose(10) + f" {i}", "en", "s", 1) for i in range(300)]
    rows = [(i, prose(30), "en", "s", 1) for i in range(100, 700)] + [(1001, prose(4000), "en", "s", 1)]
    docs = spark.createDataFrame(hot + rows, SCHEMA)
    table = common.training_texts(docs.select("doc_id", "text", F.lit(1).alias("label")), 1 << 20)
    ids = table["doc_id"].to_pylist()
    assert len(ids) == len(set(ids)) == 602 and 1001 in ids
    small = common.training_texts(docs.select("doc_id", "text", F.lit(1).alias("label")), 5000)
    assert 0 < sum(len(t.encode()) for t in small["text"].to_pylist()) <= 5000
    labels = docs.select("doc_id", F.lit(1).alias("quality"), (F.col("doc_id") % 2).alias("toxic")).distinct()
    assert language_id.report(docs).count() == toxicity.report(docs, labels).count() == quality.report(docs, labels).count() == 901


# 5


def brute_classes(rows, threshold=0.8):
    sets = []
    for _, t in rows:
        w = words7(t)
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset())
    n, up = [0] * len(rows), list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]) - 1e-9:
                n[i] += 1
                n[j] += 1
                up[root(i)] = root(j)
    low = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        low[root(i)].append((d is None, d))
    return Counter((d, min(low[root(i)])[1], n[i]) for i, (d, _) in enumerate(rows))


@pytest.mark.parametrize("block", [1024, 2])
def test_near_duplicates(spark, docs, block, monkeypatch):
    real = near_dup.classes
    monkeypatch.setattr(near_dup, "classes", lambda d: real(d, block=block))
    got = Counter((r.doc_id, r.class_id, r.n_links) for r in near_dup.report(clashing(docs)).collect())
    assert got == brute_classes([(x[0], x[1]) for x in corpus()])
    assert near_dup.report(empty(spark)).count() == 0


@pytest.mark.parametrize("k", [2, 6, 10])
def test_forest_edges_join_what_shares_a_prefix(spark, k):
    r = np.random.default_rng(k)
    base = r.integers(0, 4, (60, near_dup.TREES, near_dup.DEPTH))
    base[30:] = base[:30]
    base[30:, :, 7:] = r.integers(0, 4, (30, near_dup.TREES, 3))
    pack = lambda v: [int(sum(int(x) << (12 * (4 - i)) for i, x in enumerate(p))) for p in v]
    rows = [(i, pack(b[:, :5]), pack(b[:, 5:])) for i, b in enumerate(base)]
    sets = spark.createDataFrame(rows, "set long, high array<long>, low array<long>")
    near = {(i, j) for i in range(60) for j in range(i) for t in range(near_dup.TREES) if (base[i, t, :k] == base[j, t, :k]).all()}
    edges = [(e.src, e.dst) for e in near_dup.forest_edges(sets, k).collect()]
    assert edges and all((max(e), min(e)) in near for e in edges) or k < 6

    def groups(pairs):
        up = list(range(60))
        root = lambda x: x if up[x] == x else root(up[x])
        for a, b in pairs:
            up[root(a)] = root(b)
        return {frozenset(j for j in range(60) if root(j) == root(i)) for i in range(60)}

    assert groups(edges) == groups(near)


def test_near_duplicates_recall(spark):
    """Documents with ids divisible by 50 against all rows, exactly: none of their links is lost."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet").select("doc_id", "text").collect()]
    made = {}
    for d, t in rows:
        w = words7(t)
        made[d] = frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()
    got = {r.doc_id: r.n_links for r in near_dup.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = {d: sum(e != d and len(s & o) * 1.8 >= 0.8 * (len(s) + len(o)) - 1e-9 for e, o in made.items() if o) if s else 0 for d, s in made.items() if d % 50 == 0}
    assert sum(want.values()) > 0 and {d: got[d] for d in want} == want


def test_keep_one(spark, docs):
    rows = corpus()
    want = Counter()
    for (d, c, _), k in brute_classes([(x[0], x[1]) for x in rows]).items():
        want[d] += k if not words7(dict((x[0], x[1]) for x in rows)[d]) else int(d == c)
    got = near_dup.keep_one(clashing(docs))
    assert got.columns == clashing(docs).columns
    assert Counter(r.doc_id for r in got.collect()) == +want
    assert got.where("text is null").count() == 2


def test_classes_that_share_an_id(spark):
    r = random.Random(12)
    a, b, c, d, e = (prose(60, r) for _ in range(5))
    near = lambda t: t.replace(t.split()[30], "changed", 1)
    # all-null classes, an id of unrelated texts, and a class whose representative shares its id with another
    rows = [(None, a), (None, b), (None, near(b)), (None, c), (None, c), (7, d), (7, e), (8, near(e)), (9, near(d)), (None, d)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = Counter((x.doc_id, x.text) for x in near_dup.keep_one(docs).collect())
    one_of = [[(None, a)], [(None, b), (None, near(b))], [(None, c)], [(7, d)], [(7, e)]]
    assert sum(kept.values()) == 5 and all(sum(kept[x] for x in group) == 1 for group in one_of)
    found = near_dup.report(docs).collect()
    assert Counter((x.doc_id, x.class_id, x.n_links) for x in found) == brute_classes(rows)
    assert len({x.class_key for x in found}) == 5


def test_forest_prefix_and_counts():
    k = near_dup.prefix_length()
    assert 1 - (1 - 0.8**k) ** near_dup.TREES >= 0.9999 > 1 - (1 - 0.8 ** (k + 1)) ** near_dup.TREES
    # what is measured shortens further, never less
    assert near_dup.prefix_length({10: 1000}) == k and near_dup.prefix_length({10: 1000, k - 2: 5}) == k - 2 and near_dup.prefix_length({0: 9}) == 1
    r = np.random.default_rng(3)
    sets = [np.unique(r.integers(0, 60, r.integers(1, 50))) for _ in range(60)]
    idx = np.arange(60)
    want = [[len(np.intersect1d(a, b)) for b in sets[30:]] for a in sets[:30]]
    assert (near_dup.common_counts(sets, idx[:30], idx[30:]) == want).all()


# 6


def brute_repeats(rows, length=100):
    seen, out = set(), {}
    for d, t in sorted(rows, key=lambda x: x[0]):
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - length + 1):
            k = raw[i : i + length]
            if k in seen:
                gone[i : i + length] = b"\1" * length
            seen.add(k)
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        out[d] = (len(raw), sum(gone), sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone)), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("group_rows", [4096, 2])
def test_suffix_dedup(spark, docs, group_rows):
    rows = {x[0]: x[1] for x in corpus() if x[0] is not None}
    want = brute_repeats(list(rows.items()))
    table = clashing(docs.where("doc_id is not null"))
    got = [(r.doc_id, tuple(r[RESULT])[:4]) for r in suffix_dedup.annotate(table, group_rows=group_rows).collect()]
    assert len(got) == len(corpus()) - 1
    assert all(want[d] == tuple(v) for d, v in got)
    assert suffix_dedup.report(empty(spark)).count() == 0
    nulls = suffix_dedup.report(docs).where("doc_id is null").first()
    assert nulls.n_removed == nulls.n_bytes  # sorts last, so its text stood before


@pytest.mark.parametrize("group_rows", [4096, 2])
def test_suffix_dedup_of_rows_that_share_an_id(spark, group_rows):
    r = random.Random(13)
    passages = [prose(40, r) for _ in range(5)]
    # so many that 16 bits of the hashes meet; copies without an id, equal rows among them; two texts of one id
    texts = [prose(r.randrange(60), r) + " " + r.choice(passages) + " " + prose(r.randrange(20), r) for _ in range(1500)]
    rows = [(None, t, "s") for t in texts] + [(None, texts[0], "s"), (None, texts[0], "t"), (None, "short", "s"), (None, "short", "s")]
    same = prose(40, r)
    rows += [(5, same + "x" * 120, "s"), (5, same + "y" * 60, "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    ordered = docs.select("doc_id", "text", F.xxhash64("text").alias("h")).collect()
    ordered.sort(key=lambda x: (x.doc_id is None, x.doc_id or 0, x.h))
    want = Counter((ordered[i].doc_id, *v) for i, v in brute_repeats([(i, x.text) for i, x in enumerate(ordered)]).items())
    got = suffix_dedup.annotate(docs, group_rows=group_rows).collect()
    assert Counter((x.doc_id, *tuple(x[RESULT])[:4]) for x in got) == want


@pytest.mark.parametrize("group_rows", [4096, 3])
def test_suffix_dedup_of_common_passages_in_different_surroundings(spark, group_rows):
    r = random.Random(29)
    made = ["".join(r.choice("abcdefgh ") for _ in range(n)) for n in (83, 90, 97, 99, 100, 101, 108, 150)]
    rows = []
    for i in range(400):  # one passage is in every text, many texts differ in a few bytes only
        near = "".join(r.choice("xy") for _ in range(r.randrange(12)))
        rows.append((i, near + made[i % 8] + r.choice("pq") * r.randrange(8) + made[5] + "".join(r.choice("ab") for _ in range(r.randrange(80))), "s"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    want = brute_repeats([(x[0], x[1]) for x in rows])
    got = {x.doc_id: tuple(x[RESULT])[:4] for x in suffix_dedup.annotate(docs, group_rows=group_rows).collect()}
    assert got == want


def test_removed_text_keeps_characters(spark, docs):
    out = suffix_dedup.remove_repeats(clashing(docs))
    assert out.columns == clashing(docs).columns and out.count() == len(corpus())
    assert all(r.n_chars == len(r.text) for r in out.collect())
    raw = np.frombuffer("aé".encode() * 3, np.uint8)
    assert suffix_dedup.cut(raw, np.array([2]), np.array([5])) == "aééaé"


def test_suffix_array_by_linear_grouping():
    r = random.Random(1)
    for _ in range(300):
        s = [r.randrange(r.choice([1, 2, 5])) for _ in range(r.randrange(60))]
        assert suffix_group.suffix_array(s).tolist() == sorted(range(len(s)), key=lambda i: s[i:])


# 7


def test_decontamination(spark, docs):
    long = corpus()[6][1].split()
    items = [(1, " ".join(long[5:30])), (2, "one"), (3, None), (4, "!!"), (10, " ".join(long[5:30])), (None, "one"), (5, "never seen")]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1))
    wins = defaultdict(set)
    for i, t in items:
        w = words7(t)
        if i is not None and w:
            n = min(10, len(w))
            for k in range(len(w) - n + 1):
                wins[tuple(w[k : k + n])].add(str(i))

    def judge(t):
        w = words7(t)
        hit, found = set(), set()
        for win, ids in wins.items():
            for k in range(len(w) - len(win) + 1):
                if tuple(w[k : k + len(win)]) == win:
                    hit |= set(range(k, k + len(win)))
                    found |= ids
        return (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))

    want = Counter((x[0], *judge(x[1])) for x in corpus())
    names = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    assert Counter(tuple(r[c] for c in names) for r in decontaminate.report(clashing(docs), bench).select(*names).collect()) == want
    sliced = decontaminate.annotate(docs, bench, limit=60)
    assert Counter((r.doc_id, *(r[RESULT][c] for c in names[1:])) for r in sliced.collect()) == want
    kept = decontaminate.decontaminate(clashing(docs), bench)
    assert kept.columns == clashing(docs).columns and kept.count() == sum(k for w, k in want.items() if not w[-1])
    assert decontaminate.decontaminate(docs, bench.limit(0)).count() == len(corpus())
    assert decontaminate.report(empty(spark), bench).count() == 0


@pytest.mark.parametrize("limit", [decontaminate.SLICE_BYTES, 100])
@pytest.mark.parametrize("shard", [decontaminate.SHARD_BYTES, 1500])
def test_longest_match_of_every_suffix(spark, docs, limit, shard, monkeypatch):
    """Of all suffixes, those shorter than a window too, against all places in all texts."""
    monkeypatch.setattr(decontaminate, "SHARD_BYTES", shard)
    long = corpus()[6][1].split()
    items = [("1", " ".join(long[5:30]) + " never " + " ".join(long[40:44])), ("2", "One"), (None, "çode 😀 text"), ("4", "!!"), ("5", "never seen"), ("6", corpus()[7][1]), ("6", "ab one"), ("2", "One"), ("7", None)]
    bench = spark.createDataFrame(items, "item_id string, text string")
    texts = [(r[0], words7(r[1])) for r in corpus()]
    places = defaultdict(list)
    for d, w in texts:
        for i, x in enumerate(w):
            places[x].append((d, i, w))
    want = []
    for item, text in set(items):
        w = words7(text)
        for at in range(len(w)):
            found = []
            for d, i, t in places[w[at]]:
                n = 0
                while at + n < len(w) and i + n < len(t) and t[i + n] == w[at + n]:
                    n += 1
                found.append((n, d, i))
            best = max((f[0] for f in found), default=0)
            top = sorted(((d is not None, d or 0, i) for n, d, i in found if n == best)) if best else []
            want.append((item, at, len(w) - at, best, len(top), (top[0][1] if top[0][0] else None) if top else None, top[0][2] if top else None))
    got = decontaminate.longest_matches(clashing(docs).repartition(3), bench, limit)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert max(x[3] for x in want) > decontaminate.DEPTH and any(0 < x[3] < 10 for x in want)
    assert decontaminate.longest_matches(empty(spark), bench).where("longest > 0").count() == 0
    assert decontaminate.longest_matches(docs, bench.limit(0)).count() == 0


@pytest.mark.parametrize("limit", [decontaminate.SLICE_BYTES, 60])
def test_benchmark_items_without_an_id_are_hit(spark, limit):
    r = random.Random(14)
    leak, other = prose(25, r), prose(25, r)
    docs = spark.createDataFrame([(1, "before " + leak + " after"), (2, other), (3, leak + " " + other), (4, prose(30, r))], "doc_id long, text string")
    bench = spark.createDataFrame([(None, leak), (8, other), (None, "")], "item_id long, text string")
    got = {x.doc_id: x[RESULT] for x in decontaminate.annotate(docs, bench, limit=limit).collect()}
    assert {d: (x.n_hit, x["items"], x.n_items, x.contaminated, x.longest) for d, x in got.items()} == {
        1: (25, [], 0, True, 25), 2: (25, ["8"], 1, True, 25), 3: (50, ["8"], 1, True, 25), 4: (0, [], 0, False, 0),
    }
    assert [x.doc_id for x in decontaminate.decontaminate(docs, bench).collect()] == [4]


# 8


def base_of(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    wins = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    rep = {j for i in range(len(w) - 7) if wins[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    seen, dup = set(), 0
    for line in (t or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), dup, len(rep))


def test_quality_counts_and_trees(spark):
    r = random.Random(8)
    rows, labels = [], []
    for i in range(400):
        good = i % 2
        w = [r.choice(WORDS) for _ in range(r.randint(25, 80))]
        if not good:
            w = [x if r.random() < 0.6 else "##" + x + "|" for x in w]
        rows.append((i, "\n".join(" ".join(w[k : k + 9]) for k in range(0, len(w), 9)), None, None, 0))
        labels.append((i, good, 0))
    rows += [(900, None, None, None, 0), (901, "", None, None, 0), (902, "a b\na b\n\na b\x85x #", None, None, 0), (903, "same words here again and again all day " * 30, None, None, 0), (904, prose(20000), None, None, 0)]
    ls = spark.createDataFrame(labels + [(3, 0, 0), (4, None, 0)], "doc_id long, quality int, toxic int")
    got = {x.doc_id: x for x in quality.report(clashing(spark.createDataFrame(rows, SCHEMA)), ls).collect()}
    for i, t, *_ in rows:
        x, b = got[i], base_of(t)
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words) == b
        assert x.base_failed == (b[0] < 20 or 100 * b[4] > 30 * b[0])
        assert not (x.base_failed and x.kept)
    assert np.mean([got[i].kept == bool(i % 2) for i in range(400)]) > 0.95
    assert all(x.kept != x.base_failed for x in quality.report(spark.createDataFrame(rows, SCHEMA), ls.limit(0)).collect())
    assert quality.report(empty(spark), ls).count() == 0


def test_quality_learns_from_few_labels(spark):
    r = random.Random(15)
    text = lambda good: " ".join(w if good or r.random() < 0.5 else "##" + w + "|" for w in (r.choice(WORDS) for _ in range(60)))
    docs = spark.createDataFrame([(i, text(i % 2)) for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(30)], "doc_id long, quality int, toxic int")
    got = {x.doc_id: x.kept for x in quality.report(docs, labels).collect()}
    assert all(got[i] == bool(i % 2) for i in range(30))
    assert np.mean([got[i] == bool(i % 2) for i in range(30, 60)]) > 0.9


def test_trees_are_monotone():
    r = np.random.default_rng(1)
    x = r.uniform(size=(2000, 3))
    y = (x[:, 0] + 0.5 * np.sin(9 * x[:, 1]) + r.normal(0, 0.2, 2000) > 0.6).astype(float)
    f = trees.fit(x, y, np.array([1, 0, -1]))
    assert ((f.probability(x) > 0.5) == (y > 0.5)).mean() > 0.8
    for k, sign in ((0, 1), (2, -1)):
        line = np.repeat(r.uniform(size=(50, 1, 3)), 40, 1)
        line[:, :, k] = np.linspace(0, 1, 40)
        z = f.margin(line.reshape(-1, 3)).reshape(50, 40)
        assert (np.diff(z, axis=1) * sign >= -1e-12).all()


# 10


def test_chat_round_trip(spark):
    r = random.Random(10)
    bits = ["<|end|>", "<|turn|>", "~", "~0", "[INST]", "</s>", "|", "<", "x", "\n", "é😀", "<|role:user|>", "<|loss|>"]
    rows = [(c, t, r.choice(["user", "assistant", "system", None]), None if r.random() < 0.1 else "".join(r.choice(bits) for _ in range(r.randint(0, 6)))) for c in range(30) for t in range(r.randint(1, 150))]
    rows += [(40, None, "user", "null turn"), (40, 1, "user", "tie b"), (40, 1, "user", "tie a"), (40, 1, "assistant", "tie"), (40, 1, "assistant", "tie"), (None, 1, "user", "x"), (41, -5, "assistant", "y" * 100000)]
    conv = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit(1) for c in ("chunk", "t", "ts", "piece")})
    want = defaultdict(list)
    for c, t, role, text in rows:
        want[c].append(((t is not None, t or 0), role or "", text or ""))
    formatted = chat_format.format_conversations(conv)
    parsed = {x.conv_id: [(t.role, t.text, t.loss) for t in x.turns] for x in chat_format.read_back(formatted).collect()}
    assert parsed == {c: [(role, text, role == "assistant") for _, role, text in sorted(v)] for c, v in want.items()}
    assert all("</s>" not in x.formatted and "[INST]" not in x.formatted for x in formatted.collect())
    for x in chat_format.digest(chat_format.read_back(formatted)).collect():
        loss = "".join(text for _, role, text in sorted(want[x.conv_id]) if role == "assistant")
        assert (x.loss_chars, x.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat_format.format_conversations(conv.limit(0)).count() == 0


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_registered(spark, duck, name):
    df = queries.queries()[name](spark, SF)
    if name in queries.oracle_sql():
        same_rows(df, duck, queries.oracle_sql()[name])
    elif name == "op1_token_counts":
        assert df.where("level = 3").select("version").distinct().count() == 3
    elif name == "op13_nearest_neighbours":
        assert df.count() == 5 * duck.execute("SELECT count(*) FROM embeddings WHERE vec_id % 50 = 0").fetchone()[0]
    else:
        assert df.count() == duck.execute("SELECT count(*) FROM documents").fetchone()[0]
