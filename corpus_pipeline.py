"""Corpus pipeline: documents -> good, deduplicated, masked, packed.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir)
and returns what the next one reads. All but the last keep the columns of
``documents``; ``n_chars`` follows the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noteframe.llm import common, jaccard, lines, packing, pii, quality

#: SQL cannot express a learned classifier; tests hold run() against brute force.
ORACLE_SQL = None


def _measured(docs: DataFrame, columns: list[str]) -> DataFrame:
    if "n_chars" in columns:
        docs = docs.withColumn("n_chars", F.length("text").cast("long"))
    return docs.select(*columns)


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: documents that the quality classifier rejects go."""
    common.ship_code(spark)
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: lines that an earlier line matches go, and documents that lose all their words with them."""
    common.ship_code(spark)
    name = "_lines"
    while any(c.lower().startswith(name) for c in docs.columns):  # columns of the documents keep their names and values
        name = "_" + name
    kept = lines.dedup_lines(docs, added=(name, f"{name}_gone")).where(rf"{name}_gone = 0 OR text RLIKE '[^\\s]'")
    return _measured(kept, docs.columns)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: of each group of near copies the document with the smallest id stays.

    Of rows that repeat an id with the same text one stays; rows that repeat it
    with other texts are no copies by that and stay with their id. Rows without
    id belong to no group and stay.
    """
    common.ship_code(spark)
    groups = jaccard.jaccard_components(docs)
    stays = groups.where("doc_id = component_id").select("doc_id").distinct()
    kept = docs.join(stays, "doc_id", "left_semi")
    kept = kept.withColumn("_text_hash", F.sha2("text", 256)).dropDuplicates(["doc_id", "_text_hash"]).drop("_text_hash")
    return kept.unionByName(docs.where("doc_id IS NULL")).select(*docs.columns)


def masked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: personal data is replaced by its kind."""
    common.ship_code(spark)
    return _measured(pii.mask(docs), docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: (doc_id, piece, bin_id, start, n_words) of the training sequences."""
    common.ship_code(spark)
    return packing.pack(docs)


STAGES = [("quality", good_documents), ("line_dedup", without_repeated_lines), ("near_dedup", without_near_copies),
          ("pii", masked), ("packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = common.write_table(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
