"""The pipeline's stages, each on its own input, and the guard around the optional part."""

import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from vantor.llm.queries import oracle_sql, queries

SF = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parents[2]


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("component_id", F.lit("x")).withColumn("value", F.lit(1))
    columns = docs.columns
    strange = spark.createDataFrame([(None, None, None, None, None, None, None), (10**9, "", "en", "s", 0, "x", 1), (10**9 + 1, None, None, None, None, None, 1)], "doc_id long, text string, lang string, source string, n_chars long, component_id string, value int")
    docs = docs.unionByName(strange)
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / str(i)))
        out = spark.read.parquet(str(tmp_path / str(i)))
        if i < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == columns, name
            assert {r.doc_id for r in out.select("doc_id").collect()} <= {r.doc_id for r in docs.select("doc_id").collect()}
            assert out.where("doc_id is null").count() == 1 and out.where("doc_id >= 1000000000").count() == 2
        else:
            assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and out.count() == docs.count()
        assert stage(spark, docs.limit(0), SF).count() == 0
        docs = out
    assert corpus_pipeline.run(spark, SF).count() > 0


def test_substring_stage_changes_texts(spark):
    words = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(1, f"a {words} b", 7), (2, f"c  {words}\nd", 7), (3, "e\n f", 4), (4, f"a {words} b", 7)], "doc_id long, text string, n_chars long")
    got = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.substring_stage(spark, docs, SF).collect()}
    assert got == {1: (f"a {words} b", 7), 2: ("c d", 3), 3: ("e\n f", 4), 4: ("", 0)}


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_oracle(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "pages", "labels", "benchmark"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.execute(oracle_sql()[name])
    columns = [c[0] for c in want.description]
    got = sorted(map(repr, ([r[c] for c in columns] for r in queries()[name](spark, SF).collect())))
    assert got == sorted(map(repr, map(list, want.fetchall())))


def test_entry_without_the_optional_part(tmp_path):
    """As if the folders and the pipeline module were deleted."""
    import shutil

    shutil.copytree(ROOT / "vantor", tmp_path / "vantor", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, timeout=120, check=False)
    assert said.returncode == 0, said.stderr
    assert int(said.stdout.split()[0]) > 40


def test_any_column_names(spark):
    """Names with dots, and names that stages use themselves."""
    words = " ".join(f"w{i}" for i in range(60))
    odd = ["a.b", "__id", "__leaks", "row", "id", "kept", "changed", "sha", "whole", "leaks", "value", "b`c"]
    docs = spark.createDataFrame([(1, f"a {words}", *odd), (2, f"b {words}", *odd), (3, None, *odd)], ["doc_id", "text", *odd])
    docs = docs.withColumn("doc_id", F.col("doc_id").cast("long"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        assert all(r[2:] == tuple(odd) for r in out.collect()), name
    from vantor.llm import leaks

    before, leaks.BLOCK_ITEMS = leaks.BLOCK_ITEMS, 1
    try:
        bench = spark.createDataFrame([(1, "w1 w2 w3 w4 w5 w6"), (2, "none of these words is there")], "item_id long, text string")
        got = leaks.leaks(docs, bench).select("row.*", F.col("leaks").alias("found")).collect()
        assert [[x.item_id for x in r.found] for r in got] == [[1], [1], []] and got[0][2:-1] == tuple(odd)
    finally:
        leaks.BLOCK_ITEMS = before
