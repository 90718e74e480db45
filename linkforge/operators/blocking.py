"""Blocking: capped inverted-index joins, pair support, cheap score, ranks."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkforge.config import LinkConfig
from linkforge.functions import text as T

PAIR = ["source1_entity_id", "candidate_entity_id"]
EXACT = ("full", "core", "sorted", "address")
#: Sides of up to this many estimated bytes are broadcast by Spark itself; nothing here forces it.
FLAGS = ["block_exact_full_name", "block_exact_core_name", "block_exact_sorted_name", "block_exact_address", "block_cross_country_exact_name", "block_rare_name_token", "block_rare_address_token"]


def df_eligible(df: Column, shard: Column, absolute: int, relative: float, mode: str) -> Column:
    """Whether a token with this document frequency may block, by count, by share of its shard, or by either."""
    if mode not in ("absolute", "relative", "hybrid"):
        raise ValueError(f"unknown mode {mode}")
    by_count, by_share = df <= absolute, F.lit(relative > 0) & (df / shard <= relative)
    return (df > 0) & {"absolute": by_count, "relative": by_share, "hybrid": by_count | by_share}[mode]


def effective_cap(shard: Column, cap: int, fraction: float, most: int) -> Column:
    """The posting cap, scaled with the shard up to ``most`` where a fraction is given."""
    return F.least(F.greatest(F.lit(cap), F.ceil(shard * fraction)), F.lit(most)) if fraction > 0 else F.lit(cap)


def keyed(records: DataFrame, config: LinkConfig) -> DataFrame:
    """``(entity_id, country, channel, key)``: all blocking keys of all channels from one explode."""
    one = lambda name, key: F.when(key != "", F.array(F.struct(F.lit(name).alias("channel"), key.alias("key")))).otherwise(F.array().cast("array<struct<channel:string,key:string>>"))
    many = lambda name, words: F.transform(words, lambda t: F.struct(F.lit(name).alias("channel"), t.alias("key")))
    parts = [one("full", F.col("name_full")), one("core", F.col("name_core")), one("sorted", F.col("name_sorted")), one("address", F.col("address_full")), one("cross", F.col("name_full"))]
    parts += [many("name_token", T.informative(F.col("name_tokens"), config.min_token_length)), many("address_token", T.informative(F.col("address_tokens"), config.min_token_length))]
    rows = records.select("entity_id", F.col("country_norm").alias("country"), F.explode(F.concat(*parts)).alias("k"))
    # names are compared across countries in one common scope
    return rows.select("entity_id", "country", "k.channel", "k.key", F.when(F.col("k.channel") == "cross", "*").otherwise(F.col("country")).alias("scope"))


def key_counts(feed_keys: DataFrame) -> DataFrame:
    """Document frequency of every key of the feed, with its shard's size."""
    return feed_keys.groupBy("channel", "scope", "key").agg(F.count(F.lit(1)).alias("df"))


def shard_sizes(feed: DataFrame) -> DataFrame:
    return feed.groupBy(F.col("country_norm").alias("scope")).agg(F.count(F.lit(1)).alias("shard"))


def key_limits(config: LinkConfig) -> tuple[Column, Column]:
    """(frequency allows, posting list over the cap) of a key, from ``channel, df, shard``; only tokens have a limit of frequency, and a cap that scales."""
    df, shard, channel = F.col("df"), F.col("shard"), F.col("channel")
    name = df_eligible(df, shard, config.name_token_df, config.name_df_fraction, config.df_mode)
    address = df_eligible(df, shard, config.address_token_df, config.address_df_fraction, config.df_mode)
    cap = effective_cap(shard, config.posting_cap, config.posting_cap_fraction, config.posting_cap_max)
    token = channel.isin("name_token", "address_token")
    return F.when(channel == "name_token", name).when(channel == "address_token", address).otherwise(F.lit(True)), df > F.when(token, cap).otherwise(F.lit(config.posting_cap))


def eligible_keys(counts: DataFrame, shards: DataFrame, config: LinkConfig) -> DataFrame:
    """The keys whose posting lists are probed. Longer lists are dropped whole, before the join, so no key can make more than its cap of pairs a query."""
    frequent, capped = key_limits(config)
    sized = counts.join(shards, "scope", "left").withColumn("shard", F.coalesce("shard", F.lit(0)))
    return sized.where(frequent & ~capped).select("channel", "scope", "key", "df")


def ranked_name_tokens(keys: DataFrame, counts: DataFrame, shards: DataFrame, config: LinkConfig) -> DataFrame:
    """The rarest name tokens of each query by (df, token), whatever their frequency up to the posting cap."""
    cap = effective_cap(F.col("shard"), config.posting_cap, config.posting_cap_fraction, config.posting_cap_max)
    rows = keys.where("channel = 'name_token'").join(counts, ["channel", "scope", "key"]).join(shards, "scope").where((F.col("df") > 0) & (F.col("df") <= cap))
    return rows.withColumn("n", F.expr("row_number() over (partition by entity_id order by df, key)")).where(F.col("n") <= config.ranked_name_tokens).select("entity_id", "country", "channel", "key", "scope")


def matched_keys(source: DataFrame, feed: DataFrame, config: LinkConfig) -> DataFrame:
    """``(pair, channel, key)`` rows of all channels."""
    left, right = keyed(source, config), keyed(feed, config)
    counts, shards = key_counts(right), shard_sizes(feed)
    keys = ["channel", "scope", "key"]
    allowed = eligible_keys(counts, shards, config).select(*keys)
    probes = left.join(allowed, keys, "left_semi")
    if config.ranked_name_tokens:
        probes = probes.unionByName(ranked_name_tokens(left, counts, shards, config)).distinct()
    probes = probes.select(F.col("entity_id").alias(PAIR[0]), F.col("country").alias("c1"), *keys)
    # only postings of keys that some source record probes are shuffled
    postings = right.join(probes.select(*keys).distinct(), keys, "left_semi").select(F.col("entity_id").alias(PAIR[1]), F.col("country").alias("c2"), *keys)
    return probes.join(postings, keys).where((F.col("channel") != "cross") | (F.col("c1") != F.col("c2")))


def pair_support(matched: DataFrame, tfidf: DataFrame | None = None) -> DataFrame:
    """One row a pair: a flag a channel, token hits, the name similarity and rank."""
    flag = lambda c: F.max((F.col("channel") == c).cast("int"))
    hits = lambda c: F.sum((F.col("channel") == c).cast("int")).cast("int")
    channels = ("full", "core", "sorted", "address", "cross", "name_token", "address_token")
    out = matched.groupBy(*PAIR).agg(*(flag(c).alias(f) for c, f in zip(channels, FLAGS)), hits("name_token").alias("rare_name_token_hits"), hits("address_token").alias("rare_address_token_hits"), F.max((F.col("c1") == F.col("c2")).cast("int")).alias("same_country_block"))
    if tfidf is None:
        return out.withColumns({"block_name_tfidf": F.lit(0), "name_tfidf_similarity": F.lit(0.0), "name_tfidf_rank": F.lit(0)})
    near = tfidf.groupBy(*PAIR).agg(F.max("name_tfidf_similarity").alias("name_tfidf_similarity"), F.min("name_tfidf_rank").alias("name_tfidf_rank"), F.lit(1).alias("block_name_tfidf"))
    joined = out.join(near, PAIR, "full_outer")
    same = F.when(F.col("block_name_tfidf") == 1, 1).otherwise(F.coalesce("same_country_block", F.lit(0)))
    return joined.withColumn("same_country_block", same).fillna(0)


def cheap_score(config: LinkConfig) -> Column:
    w = lambda c, k: F.col(c) * getattr(config, k)
    return (
        w(FLAGS[0], "weight_full") + w(FLAGS[1], "weight_core") + w(FLAGS[2], "weight_sorted") + F.least("rare_name_token_hits", F.lit(3)) * config.weight_name_token + w(FLAGS[3], "weight_address")
        + F.least("rare_address_token_hits", F.lit(3)) * config.weight_address_token + w("same_country_block", "weight_country") + F.col("name_tfidf_similarity") * config.weight_tfidf
    ).cast("float")


def rank_candidates(pairs: DataFrame, k: int, config: LinkConfig) -> DataFrame:
    """The ``k`` best pairs of each source record, with rank, raw and final counts and the margin to the next."""
    scored = pairs.withColumn("cheap_score", cheap_score(config))
    raw = scored.withColumn("raw_candidate_count", F.expr("count(*) over (partition by source1_entity_id)").cast("int"))
    top = raw.withColumn("cheap_rank", F.expr("row_number() over (partition by source1_entity_id order by cheap_score desc, candidate_entity_id)").cast("int")).where(F.col("cheap_rank") <= k)
    next_ = "cheap_score - lead(cheap_score, 1, cast(0 as float)) over (partition by source1_entity_id order by cheap_rank)"
    return top.withColumns({"final_candidate_count": F.least("raw_candidate_count", F.lit(k)).cast("int"), "cheap_score_margin_to_next": F.expr(next_).cast("float"), "candidate_source": F.substring("candidate_entity_id", 1, 2)})


def generate_candidates(source: DataFrame, feed: DataFrame, config: LinkConfig, k: int | None = None, tfidf: DataFrame | None = None) -> DataFrame:
    return rank_candidates(pair_support(matched_keys(source, feed, config), tfidf), k or config.candidate_k, config)


def candidates_at_k(candidates: DataFrame, k: int) -> DataFrame:
    """Ranks up to ``k`` with their count; margins stay those of the full list."""
    top = candidates.where(F.col("cheap_rank") <= k)
    return top.withColumn("final_candidate_count", F.least("raw_candidate_count", F.lit(k)).cast("int"))


def smallest_sufficient(recalls: list[tuple[int, float]], tolerance: float) -> int:
    """The smallest K whose recall is within ``tolerance`` of the best."""
    best = max((r for _, r in recalls), default=math.nan)
    return min(k for k, r in recalls if r >= best - tolerance)
