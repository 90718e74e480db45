"""Pair features, candidate-relative features and the rule score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkforge.functions import text as T

PAIR = ["source1_entity_id", "candidate_entity_id"]
_VIEWS = ["name_full", "name_core", "name_sorted", "name_tokens", "address_full", "address_tokens", "address_numeric_tokens", "country_norm"]


def join_records(pairs: DataFrame, source: DataFrame, feed: DataFrame) -> DataFrame:
    """Pairs with the views of both records, as ``l_`` and ``r_`` columns."""
    left = source.select(F.col("entity_id").alias(PAIR[0]), *(F.col(c).alias(f"l_{c}") for c in _VIEWS))
    right = feed.select(F.col("entity_id").alias(PAIR[1]), *(F.col(c).alias(f"r_{c}") for c in _VIEWS))
    return pairs.join(left, PAIR[0]).join(right, PAIR[1])


def _int(condition: Column) -> Column:
    return condition.cast("int")


def pair_features(joined: DataFrame, characters: bool = True) -> DataFrame:
    """All pairwise features; ``characters`` adds the Ratcliff-Obershelp ratio, the only one that leaves the JVM."""
    left, right = (lambda c: F.col(f"l_{c}")), (lambda c: F.col(f"r_{c}"))
    equal = lambda c: _int((left(c) != "") & (left(c) == right(c)))
    names, addresses = (left("name_tokens"), right("name_tokens")), (left("address_tokens"), right("address_tokens"))
    a, b = F.array_distinct(left("address_numeric_tokens")), F.array_distinct(right("address_numeric_tokens"))
    both, shared = (F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b))
    country = left("country_norm"), right("country_norm")
    present = (country[0] != "") & (country[1] != "")
    out = {f"{c.replace('_full', '') if c == 'address_full' else c}_exact": equal(c) for c in ("name_full", "name_core", "name_sorted", "address_full")}
    out |= {"name_token_jaccard": T.token_jaccard(*names), "address_token_jaccard": T.token_jaccard(*addresses), "name_shared_token_count": F.size(F.array_intersect(*names)), "address_shared_token_count": F.size(F.array_intersect(*addresses))}
    out |= {"name_token_count_difference": F.abs(F.size(F.array_distinct(names[0])) - F.size(F.array_distinct(names[1]))), "name_length_ratio": T.length_ratio(left("name_full"), right("name_full")), "address_length_ratio": T.length_ratio(left("address_full"), right("address_full"))}
    out |= {"name_prefix_ratio": T.edge_ratio(left("name_full"), right("name_full")), "name_suffix_ratio": T.edge_ratio(left("name_full"), right("name_full"), True)}
    out |= {"numeric_token_equal": _int(both & (F.array_sort(a) == F.array_sort(b))), "numeric_token_overlap": F.when(both, shared / F.size(F.array_union(a, b))).otherwise(0.0), "numeric_token_conflict": _int(both & (shared == 0))}
    out |= {"address_missing_left": _int(left("address_full") == ""), "address_missing_right": _int(right("address_full") == ""), "country_missing_left": _int(country[0] == ""), "country_missing_right": _int(country[1] == "")}
    out |= {"same_country": _int(present & (country[0] == country[1])), "country_conflict": _int(present & (country[0] != country[1])), "both_country_present": _int(present), "source_is_s2": _int(F.col(PAIR[1]).startswith("S2-")), "source_is_s3": _int(F.col(PAIR[1]).startswith("S3-"))}
    if characters:
        out["name_character_similarity"] = T.character_similarity(left("name_full"), right("name_full"))
    return joined.withColumns(out).drop(*(f"{s}_{c}" for s in "lr" for c in _VIEWS))


def missing_records(pairs: DataFrame, source: DataFrame, feed: DataFrame) -> DataFrame:
    """Pairs that refer to a record that isn't there."""
    left = pairs.join(source.select(F.col("entity_id").alias(PAIR[0])), PAIR[0], "left_anti")
    right = pairs.join(feed.select(F.col("entity_id").alias(PAIR[1])), PAIR[1], "left_anti")
    return left.select(*PAIR).unionByName(right.select(*PAIR)).distinct()


def relative_features(pairs: DataFrame, columns: dict[str, str], close: str | None = None, tolerance: float = 0.05) -> DataFrame:
    """Per source record: rank and top margin of each of ``columns`` (name -> short name), gap to the best, close competitors."""
    out = {}
    for column, short in columns.items():
        out[f"relative_{short}_rank"] = F.expr(f"row_number() over (partition by source1_entity_id order by {column} desc, candidate_entity_id)").cast("int")
        best = f"max({column}) over (partition by source1_entity_id)"
        second = f"coalesce(nth_value({column}, 2) over (partition by source1_entity_id order by {column} desc, candidate_entity_id rows between unbounded preceding and unbounded following), {best})"
        out[f"{short}_top_margin"] = F.expr(f"{best} - {second}")
        out[f"{short}_gap_to_best"] = F.expr(f"{best} - {column}")
    if close:
        out["close_competitor_count"] = F.expr(f"sum(cast({close} >= best_close - {tolerance} as int)) over (partition by source1_entity_id)").cast("int")
        pairs = pairs.withColumn("best_close", F.expr(f"max({close}) over (partition by source1_entity_id)"))
    return pairs.withColumns(out).drop("best_close")


#: Columns of the pre-blocked address channel that a model may use, beside its rank and gap within the source record.
ADDRESS_EXTRAS = ["address_tfidf_similarity", "address_tfidf_rank", "address_route_postcode", "address_route_postcode_prefix", "address_route_numeric", "address_route_rare_token", "address_route_country_fallback", "address_route_count", "pool_size", "has_address_tfidf", "block_address_tfidf", "is_address_tfidf_only", "retrieval_channel_count"]


def address_extras(features: DataFrame, fused: DataFrame, address: DataFrame) -> DataFrame:
    """``features`` with ``ADDRESS_EXTRAS`` of ``fused`` pairs, ``relative_address_tfidf_rank`` and ``address_tfidf_gap_to_best``; pairs without the channel have zeros."""
    routes = [c for c in ADDRESS_EXTRAS if c.startswith("address_route") or c == "pool_size"]
    own = address.select(*PAIR, "address_tfidf_similarity", "address_tfidf_rank", *routes)
    has = (F.coalesce("address_tfidf_rank", F.lit(0)) > 0).cast("int")
    rows = fused.select(*PAIR, "legacy_rank", "tfidf_rank", "retrieval_channel_count").join(own, PAIR, "left")
    rows = rows.withColumns({"has_address_tfidf": has, "block_address_tfidf": has, "is_address_tfidf_only": has * ((F.col("legacy_rank") == 0) & (F.col("tfidf_rank") == 0)).cast("int")})
    out = features.drop(*ADDRESS_EXTRAS).join(rows.select(*PAIR, *ADDRESS_EXTRAS), PAIR, "left").fillna(0, ADDRESS_EXTRAS)
    best = "max(address_tfidf_similarity) over (partition by source1_entity_id)"
    rank = "row_number() over (partition by source1_entity_id order by address_tfidf_similarity desc, candidate_entity_id)"
    return out.withColumns({"relative_address_tfidf_rank": F.expr(rank).cast("int"), "address_tfidf_gap_to_best": F.expr(f"{best} - address_tfidf_similarity")})


def rule_score(features: DataFrame, characters: bool = True) -> DataFrame:
    """The precision-first score: a weighted base, floors for strong evidence, penalties for conflicts, all fixed values; kept in double.

    Without ``characters`` the base takes the name Jaccard in place of the character ratio.
    """
    c = F.col
    chars = c("name_character_similarity") if characters else c("name_token_jaccard")
    base = chars * 0.50 + c("name_token_jaccard") * 0.25 + c("address_token_jaccard") * 0.20 + c("name_length_ratio") * 0.05
    exact = (c("name_full_exact") + c("name_core_exact") + c("name_sorted_exact")) > 0
    same, conflict = c("same_country") == 1, c("numeric_token_conflict") == 1
    support = (c("address_token_jaccard") >= 0.25) | (c("numeric_token_overlap") > 0) | (c("address_exact") == 1)
    strong = (c("address_token_jaccard") >= 0.60) | (c("address_exact") == 1)
    floors = [(c("name_sorted_exact") == 1, 0.85), (c("name_core_exact") == 1, 0.88), (c("name_full_exact") == 1, 0.90), (exact & same, 0.93), (exact & same & support, 0.97), ((chars >= 0.92) & strong & same & ~conflict, 0.95), ((c("address_exact") == 1) & (c("name_token_jaccard") >= 0.50) & same, 0.94)]
    score = F.greatest(base, *(F.when(when, value).otherwise(0.0) for when, value in floors))
    score = score - F.when(c("country_conflict") == 1, 0.35).otherwise(0.0) - F.when(conflict, 0.12).otherwise(0.0)
    return features.withColumn("rule_score", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 9))


def hardness() -> Column:
    rank = lambda c: 1.0 / (1.0 + F.col(c))
    return rank("fusion_rank") * 2.0 + rank("relative_name_rank") + rank("relative_tfidf_rank") * 0.75 + rank("relative_address_rank") * 0.5 + F.col("name_character_similarity") * 0.2 + F.col("address_token_jaccard") * 0.15 + F.col("name_tfidf_similarity") * 0.1 + F.col("legacy_score") * 0.02
