"""From raw documents to packed training sequences: quality, language, near-duplicates, packing."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.llm import language, packing, quality
from fathomline.llm.common import delete_path, give_back, slices, stage_table, table
from fathomline.llm.jaccard import jaccard_components

#: Near-duplicates share this percentage of their distinct word shingles.
WORDS, PERCENT = 5, 80
#: Posterior under which a predicted language counts as no prediction.
SURE = 0.5


def _filtered(docs: DataFrame, keep: Callable[[list], np.ndarray]) -> DataFrame:
    """Rows of ``docs`` whose whole text is kept, with all their columns, in the scan's own tasks: no shuffle."""

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                texts = part.column(part.schema.get_field_index("text")).to_pylist()
                yield part.filter(pa.array(keep(texts), pa.bool_()))
        give_back()

    return docs.mapInArrow(run, docs.schema)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on labelled rows outside its held-out fifth, does not reject. A null or empty text is judged by the prior, which keeps it."""
    model = spark.sparkContext.broadcast(quality.trained(docs, table(spark, sf_dir, "labels")))
    return _filtered(docs, lambda texts: model.value.score(texts) >= quality.THRESHOLD)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language: null and empty texts, texts without a letter, unsure predictions and texts unlike every learned language go, each row by its own whole text."""
    model = spark.sparkContext.broadcast(language.trained(docs))

    def keep(texts):
        labels, scores, gains = model.value.judge(texts)
        return (np.array(labels) != language.UNKNOWN) & (scores >= SURE) & (gains > 0)

    return _filtered(docs, keep)


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest doc_id, of each component of the Jaccard join. Null ids stay, as do null, empty and wordless texts, which link with nothing.

    Of rows that repeat an id the one stays whose text, and then whose row, has the smallest hash. Long texts are compared whole.
    """
    groups, _ = stage_table(jaccard_components(docs, WORDS, PERCENT), "pipeline-groups")
    # One plan at every size, as in the join itself.
    gone = groups.filter(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct()
    kept = docs.join(gone.hint("merge"), "doc_id", "left_anti")
    repeated, _ = stage_table(groups.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").select("doc_id"), "pipeline-repeated")
    if repeated.isEmpty():
        return kept.select(docs.columns)
    # Only the rows of repeated ids are compared with each other, by an aggregate that is combined before its shuffle.
    order = F.struct(F.xxhash64("text").alias("t"), F.xxhash64(*docs.columns).alias("r"), F.struct(*docs.columns).alias("row"))
    one = kept.join(repeated, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(order).alias("m")).select("m.row.*")
    return kept.join(repeated, "doc_id", "left_anti").select(docs.columns).union(one.select(docs.columns))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 tokens, each piece with its ids (little-endian unsigned 32-bit). A null text is the end token alone; a very long one is cut into pieces."""
    return packing.packed(packing.pieces(docs, public_tokenizers.path(packing.VOCABULARY), carry_ids=True))


STAGES = [("quality", quality_stage), ("language", language_stage), ("near_duplicates", jaccard_stage), ("packing", packing_stage)]

#: Neither the classifiers nor the packing can be said in SQL; tests/llm compares the run with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written and read again before the next; a stage's table goes when the next one's is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs, path = stage_table(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before:
            delete_path(spark, before)
        before = path
    return docs
