"""The corpus pipeline: five stages from raw documents to packed sequences.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs. Stages 1 to 3 drop documents, stage 4 puts all that are left in the order of the mixture, stage 5 packs
them. All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from riffle.llm import best_fit_packing, pfair_mix, quality_cnn, registry, simhash_dedup, toxicity
from riffle.llm.common import discard, materialize, recorded, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier accepts."""
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return quality_cnn.keep_good(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that with the smallest id."""
    return simhash_dedup.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order in which the mixture takes them: files and rows follow its slots."""
    return pfair_mix.in_order(docs, registry.WEIGHTS, registry.REST_WEIGHT, registry.BLOCK_DOCS, seed=registry.MIX_SEED)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequence and place of every piece; the order of the stage before decides which sequences come first."""
    return best_fit_packing.pack_documents(docs, registry.tokenizer_path(), registry.SEQUENCE_TOKENS, place=best_fit_packing.file_place())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("quality classifier", drop_poor),
    ("SimHash near-dedup", drop_near_copies),
    ("mixing sources", mix_sources),
    ("best-fit packing", pack),
]

#: Learned models, fingerprints and a tokenizer are beyond SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the documents table. What a stage wrote is removed once the next one has been written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (_, stage) in enumerate(STAGES):
        with recorded() as made:
            docs = stage(spark, docs, sf_dir)
            if k + 1 < len(STAGES):
                docs, path = materialize(docs, f"stage-{k}")
        if k + 1 < len(STAGES):
            for old in [*(m for m in made if m != path), *([before] if before else [])]:
                discard(spark, old)
            before = path
    return docs
