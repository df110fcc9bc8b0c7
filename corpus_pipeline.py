"""The corpus pipeline: documents without toxic texts, near copies, repeated passages and benchmark leaks, as token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of docs.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vantor.llm.bpe import bpe_digests
from vantor.llm.common import bounded, quoted, scratch, table
from vantor.llm.leaks import leaks
from vantor.llm.minhash import near_duplicates
from vantor.llm.substrings import repeated_spans
from vantor.llm.toxicity import toxic_rows

#: SQL can't express a trained string kernel.
ORACLE_SQL = None


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that the model calls toxic go; null and empty ones never are. Rows don't move."""
    return toxic_rows(docs, table(spark, sf_dir, "labels"), most=250_000).where("predicted = 0").select("row.*")


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five words, 0.8) the document with the smallest id stays, rows without an id or words too."""
    with scratch(spark) as space:
        gone = near_duplicates(space, docs).where("not kept").select("doc_id").distinct().checkpoint()
    return docs.join(bounded(gone), "doc_id", "left_anti").select(*(F.col(quoted(c)) for c in docs.columns))


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words that an earlier document has go from texts; n_chars follows.

    Texts without any stay as they are, null ones too; in a changed text all white space, line feeds included, becomes
    one space between words. Other columns stay, whatever they are called.
    """
    with scratch(spark) as space:
        new = repeated_spans(space, docs).where("kept is not null").select(F.col("doc_id").alias("id"), F.col("whole").alias("sha"), "kept").distinct().checkpoint()
    ids = bounded(new.select(F.col("id").alias("changed")).distinct())
    rows = docs.select(F.struct(*(F.col(quoted(c)) for c in docs.columns)).alias("row"))
    same = rows.join(ids, F.col("row.doc_id") == F.col("changed"), "left_anti")
    # texts of an id that don't change stand beside one that does only where ids repeat
    words = F.trim(F.regexp_replace("row.text", r"[\x20\x09-\x0D]+", " "))
    some = rows.join(ids, F.col("row.doc_id") == F.col("changed"), "left_semi").withColumn("whole", F.sha2(F.coalesce(words, F.lit("")).cast("binary"), 256))
    some = some.join(new, (F.col("row.doc_id") == F.col("id")) & (F.col("whole") == F.col("sha")), "left")
    text = F.coalesce("kept", "row.text")
    changed = {"text": text}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col("kept").isNull(), F.col("row.n_chars")).otherwise(F.char_length(text)).cast(docs.schema["n_chars"].dataType)
    old = lambda c: F.col(f"row.{quoted(c)}")
    return same.select(*(old(c).alias(c) for c in docs.columns)).union(some.select(*(changed.get(c, old(c)).alias(c) for c in docs.columns)))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that hold a benchmark item go; null and empty ones hold none. Rows don't move."""
    return leaks(docs, table(spark, sf_dir, "benchmark"), min_words=1).where(F.size("leaks") == 0).select("row.*")


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of each text's token ids and of what they decode to; workers remember less than alone, as executors have served other stages."""
    return bpe_digests(docs, public_tokenizers.path("byte_bpe_50k.json"), most=150_000)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity_stage),
    ("near_dedup", near_dedup_stage),
    ("substring_dedup", substring_stage),
    ("decontamination", decontamination_stage),
    ("bpe", bpe_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    with scratch(spark) as space:
        docs = table(spark, sf_dir, "documents")
        for _, stage in STAGES[:-1]:
            before, docs = docs, space.table(stage(spark, docs, sf_dir))
            if before.inputFiles() and before.inputFiles()[0].startswith(space.root):
                space.drop(before)
        return STAGES[-1][1](spark, docs, sf_dir).checkpoint()
