"""The pipeline's stages on a small table, and SQL of the operators that have one."""

import os
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from seqlake.llm import langid, nearcopies, queries
from seqlake.plans.workspace import shared_folder


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert len(corpus_pipeline.STAGES) == 5
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf).cache()
        if name != "sequences":
            assert out.columns == docs.columns
        if name == "personal_data":
            assert out.count() == docs.count()
        if name in ("language", "near_duplicates"):
            assert docs.count() * 0.5 < out.count() <= docs.count()
        if name == "sequences":
            assert out.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 1024").count() == 0
        docs = out


def test_run(spark, sf):
    """The pieces of every sequence lie gapless in it and every document's pieces make it whole; nothing but the last stage's rows is left."""
    at = shared_folder(spark).removeprefix("file://")
    before = set(os.listdir(at))
    out = corpus_pipeline.run(spark, sf).toPandas()
    left = set(os.listdir(at)) - before
    assert len(left) == 1 and next(iter(left)).startswith("pipeline-sequences-")
    for _, g in out.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == [0, *g.length.cumsum()[:-1]] and g.length.sum() <= 1024
    pieces = out.groupby("doc_id")
    assert (pieces.length.sum() % pieces.doc_tokens.first() == 0).sum() > 0.5 * len(pieces) and len(out) > 100


def test_run_by_plain_stages(spark, sf):
    """What is left of a small table, by plain versions of the stages that drop or change text."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:3]:
        kept = stage(spark, kept, sf)
    kept = {r.doc_id: r.text for r in kept.collect()}
    rows = {r.doc_id: r.text for r in docs.collect()}
    sets = {d: set(nearcopies.shingles((t or "").encode()).tolist()) for d, t in rows.items()}
    lost = [d for d in sorted(rows) if d not in kept]
    known = {d for d, t in rows.items() if t and any(c.isalpha() for c in t)}
    for d in lost:  # a copy of something that stays, perhaps over others, or of no known language
        near = [e for e in rows if e != d and sets[e] and len(sets[d] & sets[e]) >= 0.8 * len(sets[d] | sets[e])]
        assert near or d not in known or langid.op3(spark, docs).where(f"doc_id = {d}").first().score < 0.6
    for d in kept:
        assert not [e for e in kept if e < d and len(sets[d] & sets[e]) >= 0.8 * len(sets[d] | sets[e])]
        if not any(c.isdigit() or c == "@" for c in rows[d]):
            assert kept[d] == rows[d]


def test_operators_ship_themselves(tmp_path):
    """Workers that have no path to the package run an operator on a table of the user's."""
    code = f"""
import sys
sys.path.insert(0, {str(Path(__file__).parents[2])!r})
from pyspark.sql import SparkSession
s = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
from seqlake.llm import packing, simhash
df = s.createDataFrame([(1, "a b c"), (2, "a b c")], "doc_id long, text string")
print("kept", simhash.keep_one(df).count(), packing.op7(s, df).count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "kept 1 2" in done.stdout, done.stderr[-2000:]
    assert not [f for f in (tmp_path / "spark-warehouse" / "checkpoints").rglob("*.parquet")]


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    got = queries.queries()[name](spark, sf)
    cols = sorted(got.columns)
    rel = con.execute(queries.oracle_sql()[name])
    names = [c[0] for c in rel.description]
    want = [tuple(r[names.index(c)] for c in cols) for r in rel.fetchall()]
    show = lambda rows: sorted(tuple(f"{v:.6g}" if isinstance(v, float) else str(v) for v in r) for r in rows)
    assert show(got.select(*cols).collect()) == show(want)
