"""Splits, nested density samples, hard negatives, bounded universes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkforge.functions.text import stable_fraction


def entity_split(ids: DataFrame, fraction: float, seed: int, id_col: str = "source1_entity_id") -> DataFrame:
    """``is_validation`` by the id alone, so splits are disjoint and stable."""
    return ids.withColumn("is_validation", stable_fraction(F.col(id_col), seed) < fraction)


def hash_split(ids: DataFrame, fraction: float, seed: int, id_col: str = "source1_entity_id") -> DataFrame:
    """The same with MD5, wholly inside the JVM."""
    place = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col))), 1, 12), 16, 10).cast("double") / float(1 << 48)
    return ids.withColumn("is_validation", place < fraction)


def first_entities(ids: DataFrame, limit: int, seed: int, id_col: str = "source1_entity_id") -> DataFrame:
    return ids.orderBy(stable_fraction(F.col(id_col), seed), id_col).limit(limit)


def bounded_universe(feed: DataFrame, truth: DataFrame, distractors: int) -> DataFrame:
    """All linked feed records and ``distractors`` others, the first by id."""
    linked = truth.select(F.col("candidate_entity_id").alias("entity_id")).distinct()
    others = feed.join(linked, "entity_id", "left_anti").orderBy("entity_id").limit(distractors)
    return feed.join(linked, "entity_id", "left_semi").unionByName(others)


def distractor_ranks(feed: DataFrame, truth: DataFrame, seed: int) -> DataFrame:
    """Unlinked feed records of each source in a seeded hash order, so that smaller samples nest in larger ones."""
    linked = truth.select(F.col("candidate_entity_id").alias("entity_id")).distinct()
    rows = feed.join(linked, "entity_id", "left_anti").withColumn("feed_source", F.substring("entity_id", 1, 2))
    order = f"row_number() over (partition by feed_source order by md5(concat('{seed}|', entity_id)), entity_id)"
    return rows.withColumn("distractor_rank", F.expr(order).cast("int"))


def density(ranked: DataFrame, total: int) -> DataFrame:
    if total % 2:
        raise ValueError("the total must be even: half from each source")
    return ranked.where(F.col("distractor_rank") <= total // 2)


def hard_negatives(pairs: DataFrame, hardness: F.Column, per_positive: int = 5) -> DataFrame:
    """All positives and, of each entity, the max(5, 5 a positive) hardest negatives."""
    rows = pairs.withColumn("hardness", hardness).withColumn("positives", F.expr("sum(label) over (partition by source1_entity_id)"))
    place = F.expr("row_number() over (partition by source1_entity_id, label order by hardness desc, candidate_entity_id)")
    limit = F.greatest(F.lit(per_positive), F.col("positives") * per_positive)
    return rows.withColumn("place", place).where((F.col("label") == 1) | (F.col("place") <= limit)).drop("place", "positives")
