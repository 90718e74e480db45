"""A corpus pipeline of five stages; each works on all that the one before it kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkforge.llm import decontaminate, lang_id, mixing, sharding, simhash
from linkforge.llm.common import discard, read_table, staged

#: A document is kept if one language holds at least this share of its words.
LEAST_SCORE = 0.4


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without letters (null and empty ones too) and those in which no language holds the least share of the words.

    Every row is judged by its own text; ids, repeats and further columns don't matter, and all columns are kept.
    """
    labelled = lang_id.identify(docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "lang"), text_col="row.text", carry=("row",))
    return labelled.where((F.col("lang_pred") != lang_id.UNDETERMINED) & (F.col("score") >= LEAST_SCORE)).select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near copies: that with the smallest id, and of several texts of that id the one with the smallest hash.

    Rows are told apart by id and text, so rows of one id with different texts stay or go by themselves; of rows equal
    in both one stays, that with the first lang, source and n_chars. Null ids come after all others; all columns are kept.
    """
    groups = simhash.verified_groups(docs)
    of = lambda rows: rows.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_hash"))
    kept = docs.join(of(groups.where("not is_first")), same, "left_anti")
    twice = groups.where("is_first").groupBy("doc_id", "text_hash").count().where("count > 1")
    if twice.isEmpty():
        return kept
    row = F.min_by(F.struct(*docs.columns), F.struct("lang", "source", "n_chars")).alias("row")
    one = kept.join(of(twice), same, "left_semi").groupBy("doc_id", F.xxhash64("text")).agg(row).select("row.*")
    return kept.join(of(twice), same, "left_anti").unionByName(one)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops every row whose text holds a benchmark item; rows of null texts stay, ids don't matter, and all columns are kept."""
    return decontaminate.remove_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or drops whole documents so that the sources' words come near their targets.

    Null sources are one source, wordless texts stay once, null and repeated ids are rows like others, and all columns are kept.
    """
    return mixing.materialise(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts all rows into 8 shards of near equal bytes, with their places; columns named size, text_crc32, shard or slot are replaced."""
    return sharding.shard_by_bytes(docs, 8)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mix),
    ("sharding", shard),
]

#: The stages hash, learn and align; SQL can't express them. tests/llm holds them against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again as the next one's input."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        was, docs = docs, staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if name != STAGES[0][0]:
            discard(was)  # the stage before's, never the input
    return STAGES[-1][1](spark, docs, sf_dir)
