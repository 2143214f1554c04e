"""The pipeline, stage by stage, against brute force; edge rows; and the entry point with and without it."""

import re
import subprocess
import sys
from collections import Counter, defaultdict
from pathlib import Path

import corpus_pipeline
import pytest
from test_llm_operators import WORD, classes, fold, passages_by_brute_force, print_of

SF_DIR = "/root/testdata/sf0.001"
ROOT = Path(corpus_pipeline.__file__).parent


def stage(name):
    return dict(corpus_pipeline.STAGES)[name]


def texts(df):
    return [(r.doc_id, r.text) for r in df.collect()]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF_DIR}/documents.parquet")


def test_stages_by_brute_force(spark, docs, tmp_path_factory):
    kept = docs
    for name in ("quality", "near_duplicates", "passages", "decontamination"):
        path = str(tmp_path_factory.mktemp("stage") / name)
        before = texts(kept)
        out = stage(name)(spark, kept, SF_DIR)
        assert out.columns == docs.columns
        out.write.parquet(path)
        kept = spark.read.parquet(path)
        after = texts(kept)
        if name == "quality":
            labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF_DIR}/labels.parquet").collect()}
            judged = [(labels[d] == 1) == (d in {a for a, _ in after}) for d, _ in before if d in labels]
            assert sum(judged) / len(judged) > 0.95
        if name == "near_duplicates":
            prints = {d: print_of(t) for d, t in before}
            group, least = classes(prints.values()), defaultdict(list)
            for d, p in prints.items():
                least[group[p]].append(d)
            assert sorted(after) == sorted((d, t) for d, t in before if d in {min(g) for g in least.values()})
        if name == "passages":
            assert sorted((str(d), WORD.findall(t)) for d, t in after) == [(d, w) for d, _, w in passages_by_brute_force(before)]
            assert all(r.n_chars == len(r.text) for r in kept.collect())
        if name == "decontamination":
            windows = set()
            for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect():
                w = fold(r.text)
                windows |= {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9))} if w else set()
            sizes = {len(x) for x in windows}
            clean = [d for d, t in before if not any(tuple(fold(t)[i : i + n]) in windows for n in sizes for i in range(len(fold(t)) - n + 1))]
            assert sorted(d for d, _ in after) == sorted(clean)
    mixed = stage("mixture")(spark, kept, SF_DIR).collect()
    assert Counter(r.doc_id for r in mixed) == Counter(d for d, _ in texts(kept))
    taken, target = Counter(), {}
    for r in mixed:
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert all(abs(taken[s] - t) <= 0.5 for s, t in target.items())


def test_stages_on_edge_rows(spark, corpus, nothing):
    for frame in (corpus, nothing):
        for name in ("quality", "near_duplicates", "passages", "decontamination"):
            out = stage(name)(spark, frame, SF_DIR)
            assert out.columns == frame.columns
            assert out.count() <= frame.count()
        assert stage("mixture")(spark, frame, SF_DIR).count() == frame.count()


def test_run_is_what_the_stages_give(spark):
    rows = corpus_pipeline.run(spark, SF_DIR)
    assert rows.columns == ["doc_id", "source", "size", "source_size", "target", "taken"]
    assert rows.count() > 0


def test_entry_lists_the_operators():
    import __spark_entry__ as entry

    assert {f"op{n}" for n in range(1, 11)} <= {q.split("_")[0] for q in entry.queries()}
    assert "pipeline" in entry.queries() and "pipeline" not in entry.oracle_sql()


def test_library_does_not_import_the_subpackage():
    for path in [*(ROOT / "tidemark").rglob("*.py"), *(ROOT / "checks").glob("*.py"), ROOT / "bench.py"]:
        if "llm" not in path.parts:
            assert not re.search(r"^\s*(from|import)\s+.*\bllm\b", path.read_text(), re.M), path


def test_entry_without_the_subpackage():
    code = "import sys; sys.modules['tidemark.llm'] = None; import __spark_entry__ as e; assert e.queries() and 'pipeline' not in e.queries()"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)
