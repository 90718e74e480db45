"""Diagnosis of retrieval and classification: what found, missed, displaced or rejected the true links, and why."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkforge.config import LinkConfig
from linkforge.functions import text as T
from linkforge.operators import blocking as B
from linkforge.operators import evaluation as E

PAIR = ["source1_entity_id", "candidate_entity_id"]


def level(*levels: tuple[str, Column]) -> Column:
    """One row for each (level, value) that a row counts in; nulls are none."""
    cells = [F.when(value.isNotNull(), F.struct(F.lit(name).alias("level"), value.cast("string").alias("value"))) for name, value in levels]
    return F.explode(F.filter(F.array(*cells), lambda x: x.isNotNull()))


def truth_links(truth: DataFrame, source: DataFrame, feed: DataFrame) -> DataFrame:
    """True links with both records' names and addresses, the countries, and how many links the source record has (0, 1, 2, 3+)."""
    views = ["business_name", "business_address", "name_full", "name_core", "name_sorted", "name_tokens", "address_full", "address_tokens"]
    side = lambda frame, pair, prefix, country: frame.select(F.col("entity_id").alias(pair), F.col("country_norm").alias(country), *(F.col(c).alias(f"{prefix}_{c}") for c in views))
    links = truth.select(*PAIR).distinct()
    sized = links.withColumn("n_true", F.expr("count(*) over (partition by source1_entity_id)"))
    out = sized.join(side(source, PAIR[0], "l", "country"), PAIR[0]).join(side(feed, PAIR[1], "r", "candidate_country"), PAIR[1])
    return out.withColumn("bucket", E.truth_bucket()).drop("n_true")


def link_keys(links: DataFrame, source: DataFrame, feed: DataFrame, config: LinkConfig) -> DataFrame:
    """``(pair, channel, key, ok, suppressed)``: the blocking keys that both records of a true link have, and whether the posting list is probed or suppressed by the cap."""
    left = B.keyed(source, config).withColumnsRenamed({"entity_id": PAIR[0], "country": "c1"})
    right_keys = B.keyed(feed, config)
    right = right_keys.withColumnsRenamed({"entity_id": PAIR[1], "country": "c2"})
    keys = ["channel", "scope", "key"]
    shared = links.select(*PAIR).join(left, PAIR[0]).join(right, [PAIR[1], *keys]).where((F.col("channel") != "cross") | (F.col("c1") != F.col("c2")))
    counts = B.key_counts(right_keys).join(B.shard_sizes(feed), "scope", "left").fillna(0, ["shard"])
    frequent, capped = B.key_limits(config)
    return shared.join(counts, keys).select(*PAIR, "channel", "key", (frequent & ~capped).alias("ok"), (frequent & capped).alias("suppressed"))


def channel_diagnosis(links: DataFrame, keys: DataFrame) -> DataFrame:
    """``(channel, level, value, true_links, recovered, unique_links)`` before ranking: overall, by country and by number of links."""
    per = keys.where("ok").select(*PAIR, "channel").distinct().withColumn("alone", F.expr("count(*) over (partition by source1_entity_id, candidate_entity_id)") == 1)
    channels = F.explode(F.array(*map(F.lit, ("full", "core", "sorted", "address", "cross", "name_token", "address_token")))).alias("channel")
    rows = links.select(*PAIR, "country", "bucket", channels).join(per, [*PAIR, "channel"], "left")
    rows = rows.select("channel", "alone", level(("all", F.lit("all")), ("country", F.col("country")), ("bucket", F.col("bucket"))).alias("x")).select("channel", "alone", "x.*")
    return rows.groupBy("channel", "level", "value").agg(F.count(F.lit(1)).alias("true_links"), F.count("alone").alias("recovered"), F.count_if(F.col("alone")).alias("unique_links"))


def suppressed_postings(keys: DataFrame) -> DataFrame:
    """How often a posting list over its cap keeps a channel from a true link."""
    return keys.groupBy("channel").agg(F.count_if("suppressed").alias("suppressed"))


def retrieval_bundle(ids: DataFrame, truth: DataFrame, candidates: DataFrame) -> DataFrame:
    """Candidate metrics of all of ``ids(source1_entity_id, country, is_validation)``, of the held-out ones, and of those by country."""
    held = F.col("is_validation")
    scoped = ids.select(PAIR[0], level(("overall", F.lit("all")), ("heldout", F.when(held, "all")), ("country", F.when(held, F.col("country")))).alias("x")).select(PAIR[0], "x.*")
    return E.candidate_metrics(scoped, truth, candidates, "level", "value")


def label_metrics(labelled: DataFrame, truth: DataFrame, source: DataFrame) -> DataFrame:
    """``(metric, value, n)``: candidate pairs, recovered, missed and negative ones, and recovered ones by feed and by country."""
    country = source.select(F.col("entity_id").alias(PAIR[0]), F.col("country_norm").alias("country"))
    positive = F.col("label") == 1
    kinds = [("total_candidate_pairs", F.lit("all")), ("recovered_positives", F.when(positive, "all")), ("negatives", F.when(~positive, "all")), ("positives_by_source", F.when(positive, F.substring(PAIR[1], 1, 2))), ("positives_by_country", F.when(positive, F.col("country")))]
    rows = labelled.join(country, PAIR[0], "left").select(level(*kinds).alias("x")).select("x.*")
    missed = truth.select(*PAIR).distinct().join(labelled.select(*PAIR), PAIR, "left_anti").select(F.lit("missed_positives").alias("level"), F.lit("all").alias("value"))
    return rows.unionByName(missed).groupBy(F.col("level").alias("metric"), "value").agg(F.count(F.lit(1)).alias("n"))


def pair_summary(labelled: DataFrame) -> DataFrame:
    """Entities, pairs and positives of a pair table, by feed too."""
    s2, positive = F.col(PAIR[1]).startswith("S2-"), F.col("label") == 1
    per = labelled.groupBy(PAIR[0]).agg(F.count(F.lit(1)).alias("pairs"), F.count_if(positive).alias("positive"), F.count_if(s2).alias("s2"), F.count_if(s2 & positive).alias("positive_s2"))
    total = {c: F.sum(c) for c in ("pairs", "positive", "s2", "positive_s2")}
    negative = total["pairs"] - total["positive"]
    return per.agg(
        F.count(F.lit(1)).alias("entities"), total["pairs"].alias("pairs"), total["positive"].alias("positive_pairs"), negative.alias("negative_pairs"), F.when(negative > 0, total["positive"] / negative).alias("positive_negative_ratio"), F.avg("pairs").alias("average_pairs"),
        total["s2"].alias("pairs_s2"), (total["pairs"] - total["s2"]).alias("pairs_s3"), total["positive_s2"].alias("positives_s2"), (total["positive"] - total["positive_s2"]).alias("positives_s3"),
    )


def truth_distribution(ids: DataFrame, truth: DataFrame) -> DataFrame:
    """How many source records have 0, 1, 2, or 3 and more links."""
    counts = ids.join(truth.select(*PAIR).distinct().groupBy(PAIR[0]).agg(F.count(F.lit(1)).alias("n_true")), PAIR[0], "left").fillna(0)
    return counts.groupBy(E.truth_bucket().alias("bucket")).agg(F.count(F.lit(1)).alias("entities"))


def link_outcomes(truth: DataFrame, **sets: DataFrame) -> DataFrame:
    """True links with a boolean a pair set: whether it holds the link."""
    out = truth.select(*PAIR).distinct()
    for name, pairs in sets.items():
        out = out.join(pairs.select(*PAIR).distinct().withColumn(name, F.lit(True)), PAIR, "left")
    return out.fillna(False, list(sets))


def fusion_record(ids: DataFrame, truth: DataFrame, legacy: DataFrame, near: DataFrame, fused: DataFrame) -> DataFrame:
    """Candidate metrics of a fused list, with the true links of the legacy list that it keeps, and those of its failures that TF-IDF found and that it keeps."""
    links = link_outcomes(truth, legacy=legacy, near=near, final=fused)
    count = lambda c: F.count_if(F.expr(c))
    kept = links.agg(count("legacy").alias("legacy_true"), count("legacy and final").alias("legacy_retained"), count("legacy and not final").alias("legacy_displaced"), count("not legacy").alias("legacy_failures"), count("not legacy and near").alias("failures_retrieved"), count("not legacy and final").alias("failures_retained"), count("not legacy and near and not final").alias("failures_lost"))
    kept = kept.withColumn("retention", F.when(F.col("legacy_true") > 0, F.col("legacy_retained") / F.col("legacy_true")).otherwise(1.0))
    return E.candidate_metrics(ids, truth, fused).withColumn("_one", F.lit(1)).join(kept.withColumn("_one", F.lit(1)), "_one").drop("_one")


def best_fusion(records: DataFrame) -> DataFrame:
    """The best record by recall, reachable F0.5, retention, then the smaller final K and depth."""
    return records.orderBy(F.desc("pair_recall"), F.desc("oracle_f05"), F.desc("retention"), "final_k", "depth", "variant").limit(1)


def displaced_links(truth: DataFrame, universe: DataFrame, fused: DataFrame, selected: DataFrame) -> DataFrame:
    """True links of the legacy list that a fusion drops, with their ranks, and whether another one keeps them."""
    links = truth.select(*PAIR).distinct().join(universe.where("legacy_rank > 0"), PAIR).join(fused.select(*PAIR), PAIR, "left_anti")
    kept = selected.select(*PAIR).distinct().withColumn("recovered", F.lit(1))
    return links.join(kept, PAIR, "left").fillna(0, ["recovered"]).select(*PAIR, "legacy_rank", "legacy_score", "tfidf_rank", "tfidf_similarity", "recovered")


def blocked_out(truth: DataFrame, candidates: DataFrame, near: DataFrame) -> DataFrame:
    """True links that blocking misses, with the TF-IDF similarity of those that it finds."""
    missed = truth.select(*PAIR).distinct().join(candidates.select(*PAIR), PAIR, "left_anti")
    return missed.join(near.select(*PAIR, "name_tfidf_similarity"), PAIR, "left")


def examples(rows: DataFrame, n: int, *order: Column) -> DataFrame:
    """The first ``n`` rows by ``order`` and then by pair."""
    return rows.orderBy(*order, *PAIR).limit(n)


def remaining_failure() -> Column:
    """Why a link isn't found by names either, from ``l_``/``r_`` raw and core names, ``charsim``, ``name_jaccard`` and ``address_jaccard``; the first that holds.

    The limits are fixed values.
    """
    c = F.col
    l, r, raw = c("l_name_core"), c("r_name_core"), F.lower(F.concat_ws(" ", "l_business_name", "r_business_name"))
    a, b = T.tokens(l), T.tokens(r)
    first = lambda words: F.array_join(F.transform(words, lambda t: F.substring(t, 1, 1)), "")
    bare = lambda x: F.replace(x, F.lit(" "), F.lit(""))
    short = (bare(l) == first(b)) | (bare(r) == first(a)) | ((T.length_ratio(l, r) < 0.65) & (c("charsim") >= 0.35))
    branches = [
        ("DBA/trade-name mismatch", raw.rlike(r" dba |d/b/a|doing business as| t/a | aka |trading as")), ("address-only evidence", (c("charsim") < 0.35) & (c("address_jaccard") >= 0.40)), ("transliteration/script mismatch", T.script_mismatch(l, r)),
        ("token reordering", (c("name_jaccard") >= 0.80) & (a != b) & (F.array_sort(a) == F.array_sort(b))), ("abbreviation", short), ("very short/generic name", (F.least(F.length(l), F.length(r)) <= 5) | ((F.size(a) <= 1) & (F.size(b) <= 1))),
        ("severe spelling corruption", (c("charsim") < 0.65) & (c("name_jaccard") < 0.30)),
    ]
    return E.first_of(branches, "other")


def model_false_positive() -> Column:
    """Kind of a false positive of the model; the limits are fixed values."""
    c = F.col
    exact = (c("name_full_exact") + c("name_core_exact") + c("name_sorted_exact")) > 0
    branches = [
        ("numeric-address conflict", c("numeric_token_conflict") == 1), ("same name / different address", exact & (c("address_token_jaccard") < 0.20)), ("same address / different business", (c("address_exact") == 1) & (c("name_character_similarity") < 0.65)),
        ("legal suffix only", (c("name_core_exact") == 1) & (c("name_full_exact") == 0)), ("location ambiguity", exact & (c("address_token_jaccard") < 0.50)), ("strong lexical noise", c("name_character_similarity") < 0.55), ("generic/common business name", c("name_shared_token_count") <= 1),
    ]
    return E.first_of(branches, "other high similarity collision")


def classifier_failure() -> Column:
    """Kind of a true link that the classifier rejects, from pair features and ``l_name_core``, ``r_name_core``; the limits are fixed values."""
    c = F.col
    branches = [("numeric-address conflict", c("numeric_token_conflict") == 1), ("missing address", (c("address_missing_left") == 1) | (c("address_missing_right") == 1)), ("transliteration", T.script_mismatch(c("l_name_core"), c("r_name_core"))), ("strong name / weak address", (c("name_character_similarity") >= 0.80) & (c("address_token_jaccard") < 0.25))]
    return E.first_of(branches, "other")


def importance_change(before: DataFrame, after: DataFrame) -> DataFrame:
    """``(feature, before, after, change)`` of gain shares of two models' ``(feature, gain)``; a feature that one lacks has 0 there."""
    share = lambda frame, name: frame.groupBy("feature").agg(F.sum("gain").alias("gain")).select("feature", F.expr("if(sum(gain) over () = 0, 0d, gain / sum(gain) over ())").alias(name))
    both = share(before, "before").join(share(after, "after"), "feature", "full_outer").fillna(0.0, ["before", "after"])
    return both.withColumn("change", F.col("after") - F.col("before"))


def runtime_projection(build_seconds: float, query_seconds: float, index_bytes: int, feed_rows: int, queries: int, target_feed: int = 9_969_589, target_queries: int = 1_732_544) -> dict[str, float]:
    """Measured times and bytes carried on in proportion to a larger feed and more queries."""
    feed, asked = target_feed / feed_rows, target_queries / queries
    build, query = build_seconds * feed, query_seconds * asked
    return {"feed_scale": feed, "query_scale": asked, "projected_build_seconds": build, "projected_query_seconds": query, "projected_total_seconds": build + query, "projected_total_hours": (build + query) / 3600.0, "projected_index_bytes": int(index_bytes * feed)}
