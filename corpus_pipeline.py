"""From raw documents to packed training sequences, in five stages.

Every stage is a function of (spark, docs, sf_dir); its result is written as Parquet and read again
as the next one's docs. All but the last return the columns of their docs. ``n_chars`` follows the text.
A document that a removal leaves without a word goes; one that had no word before is left alone.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import Registry, table
from tabloom.llm import line_chunks, ngram_join, packing, paragraphs
from tabloom.llm import quality_rules as quality
from tabloom.llm.text import fresh_names
from tabloom.session import cut_lineage

reg = Registry()


def wordless(text: Column) -> Column:
    return F.length(F.translate(F.coalesce(text, F.lit("")), quality.SPACE_CHARS, "")) == 0


def recounted(docs: DataFrame, columns: list[str], had: str) -> DataFrame:
    """``docs`` without texts that lost their words, ``n_chars`` counted anew; ``had`` tells who had words."""
    left = docs.filter(~(wordless(F.col("text")) & F.col(had)))
    counted = F.length("text").cast("long").alias("n_chars")
    return left.select(*[counted if c == "n_chars" else F.col(f"`{c}`") for c in columns])


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the calibrated quality rules keep."""
    measures, kept = fresh_names(docs, "measures", "kept")
    judged = quality.quality_rules(docs, table(spark, sf_dir, "labels"), keep=docs.columns, measures=measures, into=kept)
    return judged.filter(F.col(kept)).select(*[F.col(f"`{c}`") for c in docs.columns])


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the line chunks that earlier documents hold."""
    (had,) = fresh_names(docs, "had")
    marked = docs.withColumn(had, ~wordless(F.col("text")))
    return recounted(line_chunks.remove_repeated_lines(marked), docs.columns, had)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of near duplicates: that with the smallest id (null last) and text hash.

    Rows are told apart by id and text, so an id may repeat. Of rows equal in both the one with the smallest
    values stays. Texts without words are in no component.
    """
    surplus = cut_lineage(ngram_join.surplus_rows(docs))
    of, at = fresh_names(docs, "of", "at")

    def marked(rows: DataFrame, which: DataFrame, how: str) -> DataFrame:
        which = cut_lineage(which.select(F.col("id").alias(of), F.col("version").alias(at)))
        few = 16 * which.count() <= paragraphs.BROADCAST_BYTES
        same = rows["doc_id"].cast("long").eqNullSafe(F.col(of)) & (F.xxhash64(F.coalesce(rows["text"], F.lit(""))) == F.col(at))
        return rows.join(F.broadcast(which) if few else which, same, how)

    repeated = surplus.filter("kept AND copies > 1")
    left = marked(docs, surplus.filter("NOT kept OR copies > 1"), "left_anti")
    if repeated.isEmpty():
        return left
    copies = marked(docs, repeated, "left_semi")
    one = copies.groupBy(F.col("doc_id").alias("__id"), F.xxhash64("text").alias("__version"))
    one = one.agg(F.min(F.struct(*[F.col(f"`{c}`") for c in docs.columns])).alias("__row"))
    return left.unionByName(one.select(*[F.col("__row").getField(c).alias(c) for c in docs.columns]))


def paragraph_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines and passages that earlier documents hold, copied or edited."""
    (had,) = fresh_names(docs, "had")
    marked = docs.withColumn(had, ~wordless(F.col("text")))
    return recounted(paragraphs.remove_repeated_paragraphs(marked), docs.columns, had)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 2048 tokens."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"))


STAGES = [
    ("quality_rules", quality_stage),
    ("line_dedup", line_stage),
    ("ngram_jaccard_join", near_duplicate_stage),
    ("substring_dedup", paragraph_stage),
    ("best_fit_packing", packing_stage),
]

#: Tokens, rolling hashes and components are beyond SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every result but the last is a written table."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


reg.add("pipeline", ORACLE_SQL)(run)
