"""Rank fusion of retrieval channels; every operator ranks by column expressions and one window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PAIR = ["source1_entity_id", "candidate_entity_id"]
_LAST = 65535


def two_channels(legacy: DataFrame, tfidf: DataFrame, depth: int) -> DataFrame:
    """Full outer union of the legacy candidates and the first ``depth`` TF-IDF ones; absent ranks and scores are 0."""
    left = legacy.select(*PAIR, F.col("cheap_rank").alias("legacy_rank"), F.col("cheap_score").cast("double").alias("legacy_score"))
    right = tfidf.where(F.col("name_tfidf_rank") <= depth).select(*PAIR, F.col("name_tfidf_rank").alias("tfidf_rank"), F.col("name_tfidf_similarity").alias("tfidf_similarity"))
    out = left.join(right, PAIR, "full_outer").fillna(0, ["legacy_rank", "legacy_score", "tfidf_rank", "tfidf_similarity"])
    has = lambda c: (F.col(c) > 0).cast("int")
    return out.withColumns({"is_legacy_only": has("legacy_rank") * (1 - has("tfidf_rank")), "is_tfidf_only": has("tfidf_rank") * (1 - has("legacy_rank")), "supported_by_both": has("legacy_rank") * has("tfidf_rank")})


def three_channels(universe: DataFrame, address: DataFrame) -> DataFrame:
    right = address.select(*PAIR, F.col("address_tfidf_rank").alias("address_rank"), "address_tfidf_similarity")
    out = universe.join(right, PAIR, "full_outer").fillna(0)
    has = lambda c: (F.col(c) > 0).cast("int")
    return out.withColumn("retrieval_channel_count", has("legacy_rank") + has("tfidf_rank") + has("address_rank"))


def _place(rank: str) -> Column:
    return F.when(F.col(rank) > 0, F.col(rank)).otherwise(_LAST)


def _cap(scored: DataFrame, final_k: int, *order: Column) -> DataFrame:
    from pyspark.sql import Window

    window = Window.partitionBy(PAIR[0]).orderBy(*order, "candidate_entity_id")
    return scored.withColumn("fusion_rank", F.row_number().over(window)).where(F.col("fusion_rank") <= final_k)


def _two(scored: DataFrame, final_k: int) -> DataFrame:
    return _cap(scored, final_k, F.desc("fusion_score"), F.desc("supported_by_both"), _place("legacy_rank"), _place("tfidf_rank"))


def _three(scored: DataFrame, final_k: int) -> DataFrame:
    return _cap(scored, final_k, F.desc("fusion_score"), F.desc("retrieval_channel_count"), _place("legacy_rank"), _place("tfidf_rank"), _place("address_rank"))


def _term(rank: str, weight: float, constant: float) -> Column:
    return F.when(F.col(rank) > 0, F.lit(float(weight)) / (F.lit(float(constant)) + F.col(rank))).otherwise(0.0)


def _positive(**values) -> None:
    bad = [k for k, v in values.items() if v < 0]
    if bad:
        raise ValueError(f"negative {', '.join(bad)}")


def reciprocal_rank(universe: DataFrame, final_k: int, legacy_weight: float = 2.0, tfidf_weight: float = 1.0, constant: float = 20.0) -> DataFrame:
    _positive(final_k=final_k, constant=constant)
    return _two(universe.withColumn("fusion_score", _term("legacy_rank", legacy_weight, constant) + _term("tfidf_rank", tfidf_weight, constant)), final_k)


def quota(universe: DataFrame, final_k: int, legacy_quota: int, tfidf_quota: int) -> DataFrame:
    """First the legacy quota, then TF-IDF-only additions, then what is left: legacy before TF-IDF. The score is the reverse place."""
    _positive(final_k=final_k, legacy_quota=legacy_quota, tfidf_quota=tfidf_quota)
    only = F.expr("if(is_tfidf_only = 1, row_number() over (partition by source1_entity_id, is_tfidf_only order by tfidf_rank, candidate_entity_id), 0)")
    nth = F.expr("if(legacy_rank > 0, row_number() over (partition by source1_entity_id, legacy_rank > 0 order by legacy_rank, candidate_entity_id), 0)")
    rows = universe.withColumns({"_o": only, "_l": nth})
    group = F.when((F.col("_l") > 0) & (F.col("_l") <= legacy_quota), 0).when((F.col("_o") > 0) & (F.col("_o") <= tfidf_quota), 1).when(F.col("_l") > 0, 2).otherwise(3)
    rows = rows.withColumn("_g", group).withColumn("_i", F.when(F.col("_l") > 0, F.col("_l")).otherwise(F.col("_o")))
    picked = rows.withColumn("_p", F.expr("row_number() over (partition by source1_entity_id order by _g, _i, candidate_entity_id)")).where(F.col("_p") <= final_k)
    scored = picked.withColumn("fusion_score", (F.expr("count(*) over (partition by source1_entity_id)") - F.col("_p") + 1).cast("double"))
    return _two(scored.drop("_o", "_l", "_g", "_i", "_p"), final_k)


def naive_score(universe: DataFrame, final_k: int, similarity_weight: float = 4.0, only_bonus: float = 0.5) -> DataFrame:
    return _two(universe.withColumn("fusion_score", F.col("legacy_score") + F.col("tfidf_similarity") * similarity_weight + F.col("is_tfidf_only") * only_bonus), final_k)


def _minmax(value: str, rank: str) -> Column:
    present = f"if({rank} > 0, {value}, null)"
    low, high = (F.expr(f"{f}({present}) over (partition by source1_entity_id)") for f in ("min", "max"))
    scaled = F.when(high > low, (F.col(value) - low) / (high - low)).otherwise(1.0)
    return F.when(F.col(rank) > 0, scaled).otherwise(0.0)


def normalized_score(universe: DataFrame, final_k: int, legacy_weight: float = 0.6, tfidf_weight: float = 0.4, both_bonus: float = 0.1) -> DataFrame:
    score = _minmax("legacy_score", "legacy_rank") * legacy_weight + _minmax("tfidf_similarity", "tfidf_rank") * tfidf_weight + F.col("supported_by_both") * both_bonus
    return _two(universe.withColumn("fusion_score", score), final_k)


def _protect(scored: DataFrame, final_k: int, least: int, tie: str) -> DataFrame:
    """Membership: the first ``least`` legacy candidates, then the best scores; positions are by score alone."""
    legacy = F.expr("row_number() over (partition by source1_entity_id order by if(legacy_rank > 0, legacy_rank, 65535), candidate_entity_id)")
    rows = scored.withColumn("_safe", F.when((F.col("legacy_rank") > 0) & (legacy <= least), 0).otherwise(1))
    place = F.expr(f"row_number() over (partition by source1_entity_id order by _safe, if(_safe = 0, legacy_rank, 0), fusion_score desc, {tie} candidate_entity_id)")
    return rows.withColumn("_p", place).where(F.col("_p") <= final_k).drop("_safe", "_p")


def hybrid(universe: DataFrame, final_k: int, minimum_legacy: int, legacy_weight: float = 2.0, tfidf_weight: float = 1.0, constant: float = 20.0) -> DataFrame:
    scored = universe.withColumn("fusion_score", _term("legacy_rank", legacy_weight, constant) + _term("tfidf_rank", tfidf_weight, constant))
    tie = "supported_by_both desc, if(legacy_rank > 0, legacy_rank, 65535), if(tfidf_rank > 0, tfidf_rank, 65535),"
    return _two(_protect(scored, final_k, minimum_legacy, tie), final_k)


def _rrf3(universe: DataFrame, weights: tuple[float, float, float], constant: float) -> DataFrame:
    terms = [_term(r, w, constant) for r, w in zip(("legacy_rank", "tfidf_rank", "address_rank"), weights)]
    return universe.withColumn("fusion_score", terms[0] + terms[1] + terms[2])


def reciprocal_rank3(universe: DataFrame, final_k: int, weights: tuple[float, float, float] = (2.0, 1.0, 1.0), constant: float = 20.0) -> DataFrame:
    return _three(_rrf3(universe, weights, constant), final_k)


def protected3(universe: DataFrame, final_k: int, minimum_legacy: int, weights: tuple[float, float, float] = (2.0, 1.0, 1.0), constant: float = 20.0) -> DataFrame:
    return _three(_protect(_rrf3(universe, weights, constant), final_k, minimum_legacy, "retrieval_channel_count desc,"), final_k)
