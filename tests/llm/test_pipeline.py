"""The pipeline stage by stage against plain versions of what each stage does to its own input."""

import hashlib
import random
from collections import Counter
from pathlib import Path

import corpus_pipeline
import pytest
from conftest import SF
from test_operators import SCHEMA, brute_classes, brute_repeats, clashing, prose, words7

from voxelake.llm import bpe, toxicity
from voxelake.llm.common import documents


def test_stages(spark, tmp_path, duck):
    docs = documents(spark, SF)
    bench = {r[0]: words7(r[1]) for r in duck.execute("SELECT item_id, text FROM benchmark").fetchall()}
    wins = {tuple(w[k : k + min(10, len(w))]) for w in bench.values() for k in range(max(1, len(w) - 9)) if w}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r.text for r in docs.collect()}
        out = stage(spark, docs, SF)
        if i < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        docs_before, docs = docs, spark.read.parquet(str(tmp_path / name))
        assert docs.count() == docs.select("doc_id").distinct().count()
        after = {r.doc_id: r for r in docs.collect()}
        if name == "toxicity":
            gone = {r.doc_id for r in toxicity.report(docs_before, spark.read.parquet(f"{SF}/labels.parquet")).collect() if r.predicted}
            assert set(after) == set(before) - gone and gone
        elif name == "jaccard_join":
            classes = brute_classes(list(before.items()))
            assert set(after) == {d for d, c, _ in classes if d == c}
        elif name == "suffix_dedup":
            want = brute_repeats(list(before.items()))
            assert set(after) == set(before)
            for d, (n, removed, *_rest) in want.items():
                left = len(after[d].text.encode())
                assert n - removed <= left <= n - removed + 8 * _rest[0] and after[d].n_chars == len(after[d].text)
        elif name == "decontamination":
            hit = {d for d, t in before.items() for w in [words7(t)] if any(tuple(w[k : k + len(x)]) == x for x in wins for k in range(len(w) - len(x) + 1))}
            assert set(after) == set(before) - hit
        else:
            codec = bpe.Codec(bpe.Vocabulary(bpe.default_path()))
            want = Counter((d, len(codec.encode(t)), hashlib.sha256(t.encode()).hexdigest()) for d, t in before.items())
            assert Counter((r.doc_id, r.n_tokens, r.decoded_sha256) for r in after.values()) == want


def test_run(spark):
    """run() is its stages one after another, and leaves no other table behind."""
    shared = Path(spark.conf.get("spark.checkpoint.dir"))
    before = set(shared.iterdir())
    rows = corpus_pipeline.run(spark, SF).collect()
    assert rows and len({r.doc_id for r in rows}) == len(rows)
    assert [p.name.split("-")[0] for p in set(shared.iterdir()) - before] == ["stage4"]
    docs = documents(spark, SF)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert Counter(map(tuple, docs.collect())) == Counter(map(tuple, rows))


@pytest.mark.parametrize("i", range(len(corpus_pipeline.STAGES)))
def test_stages_on_odd_rows(spark, i):
    """Nulls in every column, empty and very long texts, repeated rows and ids, names that clash; then no row at all."""
    name, stage = corpus_pipeline.STAGES[i]
    r = random.Random(31)
    long, plain = prose(20000, r), [prose(80, r) for _ in range(6)]
    texts = [None, "", " \n", "one", long, *plain, plain[0], plain[1].replace(plain[1].split()[40], "changed", 1)]
    rows = [(k, t, "en", "s", 1) for k, t in enumerate(texts)] + [(3, "one", "en", "s", 1), (None, plain[2], None, None, None), (None, None, None, None, None), (7, plain[5], "en", "s", 1), (None, prose(50, r), "en", "s", 1)]
    docs = clashing(spark.createDataFrame(rows, SCHEMA))
    got = stage(spark, docs, SF).collect()
    ids = Counter(x.doc_id for x in got)
    everyone = Counter(x[0] for x in rows)
    if name == "jaccard_join":
        # of copies one stays, also where an id has two texts; textless rows all
        assert ids == Counter([0, 1, 2, None, 3, 4, 5, 6, 7, 7, 8, 9, None])
    elif name == "toxicity":  # what the labels of those ids make of such texts is open, but textless rows stay
        assert not ids - everyone and sum(not (x.text or "").strip() for x in got) == 4
    else:
        assert ids == everyone  # no passage of the benchmark, and no removal of whole rows
    if name == "suffix_dedup":
        by = {(x.doc_id, x.text) for x in got}
        assert (11, "") in by and (None, "") in by and (4, long) in by and all(x.n_chars == len(x.text) for x in got)
    if i < len(corpus_pipeline.STAGES) - 1:
        assert stage(spark, docs, SF).columns == docs.columns and all(x.tag == "tag" for x in got)
    nothing = stage(spark, docs.limit(0), SF)
    assert nothing.count() == 0 and (nothing.columns == docs.columns or i == len(corpus_pipeline.STAGES) - 1)


def test_entry_imports_without_the_subpackage(tmp_path):
    import shutil
    import subprocess
    import sys

    shutil.copytree(Path(__file__).parents[2], tmp_path / "r", ignore=shutil.ignore_patterns(".git", "__pycache__"))
    shutil.rmtree(tmp_path / "r/voxelake/llm")
    (tmp_path / "r/corpus_pipeline.py").unlink()
    code = "import __spark_entry__ as e; n = set(e.queries()); assert n and not any(x.startswith('op') or x == 'pipeline' for x in n); assert set(e.oracle_sql()) <= n"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "r", check=True, timeout=120)
