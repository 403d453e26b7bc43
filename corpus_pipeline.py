"""From raw documents to token files: five stages, each on all that its predecessor kept.

The query ``pipeline`` runs them; it counts as part of ``recallkit.llm``.

Cases, by stage: ``quality`` lets null, empty and wordless texts go, and judges very long texts,
ties and repeated rows one by one; ``near_dedup`` keeps one row of each group (that of the
smallest id; of rows that repeat an id with different texts each is judged by its own group;
rows without an id come last); ``decontaminate`` judges row by row; ``mix`` gives each row,
repeated ones too, its own share, a null source being a source; ``tokens`` has one row for each
row it gets.  Empty tables give empty results at every stage.  All but the last carry every
column of the documents, whatever its name; names starting with two underscores are ours.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from recallkit.llm import decontaminate, mixing, quality, simhash, tokens
from recallkit.llm.common import discard, read_table, stage_path
from recallkit.llm.queries import vocabulary


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the compression bands, fitted to labelled ones, reject go."""
    bands = quality.fit_bands(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
    return quality.keep_acceptable(docs, bands=bands)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each SimHash group stays: that with the smallest id."""
    return simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of a benchmark item go."""
    return decontaminate.drop_leaked(docs, read_table(spark, sf_dir, "benchmark"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out until each source has its target of words."""
    return mixing.mix_documents(docs, mixing.quality_weights(read_table(spark, sf_dir, "labels")))


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mix, read back: ``doc_id, start, n_tokens, ids_crc32`` of each row."""
    return tokens.tokenized(docs, vocabulary())


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("quality", quality_rules),
    ("near_dedup", near_dedup),
    ("decontaminate", decontamination),
    ("mix", source_mixing),
    ("tokens", token_output),
]

#: SQL has no zstandard, XXH64 fingerprints, banded alignment or BPE.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; each result is written as Parquet and read again for the next."""
    docs = read_table(spark, sf_dir, "documents")
    for number, (name, stage) in enumerate(STAGES[:-1]):
        path = stage_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.mode("overwrite").parquet(path)
        if number:
            discard(docs)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
