"""The stages of the pipeline in turn, on planted and odd documents, and the library without its llm folders."""

import os
import shutil
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

import corpus_pipeline

SF = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def stages(spark, docs):
    """What each stage gives, each one's rows being the next one's documents."""
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = out[name] = stage(spark, docs, SF).cache()
    return out


@pytest.fixture(scope="module")
def planted(spark):
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    own = " ".join(f"word{k} of, a text" for k in range(90))
    near = own.replace("word40 ", "other ")
    secret = " ".join(f"plain{k} words, here" for k in range(60)) + " password: abcdefghijklmnop123"
    rows += [(100_000, own, "en", "web", None), (100_001, near, "en", None, 3), (100_002, own, "en", "web", None), (100_003, secret, None, "web", 7)]
    rows += [(100_004, None, None, None, None), (100_005, "", "en", "web", 0), (100_003, secret, None, "web", 7), (None, "without an id, but with some words", None, None, None)]
    docs = spark.createDataFrame(rows, DOCS)
    return docs, stages(spark, docs)


def test_each_stage_keeps_the_columns(planted):
    docs, out = planted
    for name in ("toxicity", "near_dedup", "secrets", "mixing"):
        assert out[name].columns == docs.columns, name
    assert {"doc_id", "piece", "sequence_id", "offset", "length"} <= set(out["packing"].columns)


def test_toxic_documents_go_and_clean_ones_stay(spark, planted):
    docs, out = planted
    kept = {r.doc_id for r in out["toxicity"].select("doc_id").collect()}
    marked = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    right = sum((i in kept) == (not t) for i, t in marked.items())
    assert right >= 0.95 * len(marked) and {100_000, 100_003, 100_004, None} <= kept


def test_one_of_each_group_stays(planted):
    _, out = planted
    before, after = ([r.doc_id for r in out[n].select("doc_id").collect()] for n in ("toxicity", "near_dedup"))
    assert set(after) <= set(before) and not {100_001, 100_002} & set(after)
    assert after.count(100_000) == 1 and after.count(100_003) == 1 and after.count(None) == 1
    words = lambda t: tuple((t or "").lower().split())
    texts = [words(r.text) for r in out["near_dedup"].collect()]
    assert len(set(texts)) == len(texts)


def shingles(text):
    w = text.lower().split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}


def test_near_copies_are_brute_force(planted):
    """No two documents that stay are near copies, and each that goes has a chain of near copies to one that stays."""
    _, out = planted
    rows = [(r.doc_id, shingles(r.text or "")) for r in out["toxicity"].collect()]
    near = lambda a, b: len(a & b) >= 0.8 * len(a | b)
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if near(rows[i][1], rows[j][1]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    groups = {}
    for k, (i, _) in enumerate(rows):
        groups.setdefault(find(k), []).append(i)
    want = sorted(min((i for i in g if i is not None), default=-1) for g in groups.values())
    assert sorted(-1 if r.doc_id is None else r.doc_id for r in out["near_dedup"].collect()) == want


def test_no_secret_is_left(planted):
    _, out = planted
    assert out["secrets"].count() == out["near_dedup"].count()
    row = out["secrets"].where("doc_id = 100003").first()
    assert row.text.endswith("here [SECRET]") and row.n_chars == len(row.text)
    assert out["secrets"].where(F.regexp_like("text", F.lit(r"AKIA[A-Z0-9]{14}|[0-9a-f]{16}"))).count() == 0


def test_sources_near_their_targets(planted):
    from lexiloom.llm import mixing

    _, out = planted
    base, sources = mixing.prepare(out["secrets"], (3, 1, 2), 1.5, 2)
    targets = {r.source: r.target for r in sources.collect()}
    longest = {r["source"]: r["most"] for r in base.groupBy("source").agg(F.max("size").alias("most")).collect()}
    sizes = mixing.sized(out["mixing"]).groupBy("source").agg(F.sum("size").alias("n")).collect()
    for r in sizes:
        assert abs(r.n - targets[r.source]) <= longest[r.source] + 1
    copies = out["mixing"].groupBy("doc_id", "text").count().agg(F.max("count")).first()[0]
    assert copies <= 2


def test_packing_holds_every_document(planted):
    _, out = planted
    packed = out["packing"].toPandas()
    assert len(packed[packed.piece == 0]) == out["mixing"].count()
    filled = packed.groupby("sequence_id").length.sum()
    assert filled.max() <= 4096 and len(filled) <= 1.02 * -(-packed.length.sum() // 4096) + 1


def test_run_is_its_stages(spark):
    out = corpus_pipeline.run(spark, SF)
    want = stages(spark, spark.read.parquet(f"{SF}/documents.parquet"))["packing"]
    assert out.columns == want.columns and out.count() == want.count()
    assert out.agg(F.sum("length")).first() == want.agg(F.sum("length")).first()


def test_stages_take_an_empty_table(spark):
    for name, out in stages(spark, spark.createDataFrame([], DOCS)).items():
        assert out.count() == 0, name


def test_library_without_the_llm_folders(tmp_path):
    shutil.copytree(ROOT, tmp_path / "copy", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", "*.md"))
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 60 and 'knn_topk' in q and 'pipeline' not in q; assert set(e.oracle_sql()) <= set(q)"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "copy", env=env, check=True, timeout=120)
