"""The registered record-linkage queries; ``oracles`` has their DuckDB twins.

They run on the adapter view over documents, with the default limits; those that limits
decide run once more as ``capped_*``, with limits so small that they bite at small scale.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkforge.config import RULE_THRESHOLDS, LinkConfig
from linkforge.functions import text as T
from linkforge.operators import blocking as B
from linkforge.operators import diagnosis as D
from linkforge.operators import evaluation as E
from linkforge.operators import features as X
from linkforge.operators import fusion as R
from linkforge.operators import model as M
from linkforge.operators import sampling as S
from linkforge.operators import submission as O
from linkforge.operators import tfidf as V
from linkforge.plans import stages
from linkforge.sources import records as IO


@dataclass(frozen=True)
class Setting:
    """Limits of the linkage operators, and of the fusion queries."""

    config: LinkConfig
    depth: int  # TF-IDF ranks that take part in fusion
    final_k: int
    legacy_quota: int
    tfidf_quota: int
    protect: int


#: What queries run with, and limits so small that every cap and frequency filter bites at small scale.
DEFAULT = Setting(LinkConfig(), 30, 50, 35, 15, 35)
SMALL = Setting(LinkConfig(posting_cap=20, name_token_df=10, address_token_df=5, candidate_k=10, tfidf_k=10, address_k=5, pool_cap=30, numeric_max_df=10, rare_token_max_df=10, prefix_max_df=20, fallback_max_df=20), 6, 6, 3, 2, 3)
PAIR = B.PAIR
_ready: dict[tuple[str, str], tuple[DataFrame, DataFrame]] = {}


def sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(S1, feed), normalised once a session and input and written to the shared folder: every channel reads them several times."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _ready:
        rows = IO.staged(IO.normalize_records(IO.document_records(spark, sf_dir)))
        _ready[key] = rows.where(F.col("entity_id").startswith("S1-")), rows.where(~F.col("entity_id").startswith("S1-"))
    return _ready[key]


def forget(spark: SparkSession) -> None:
    """Let the next query normalise its inputs anew."""
    for key in [k for k in _ready if k[0] == spark.sparkContext.applicationId]:
        del _ready[key]


def tidy(frame: DataFrame) -> DataFrame:
    """One integer type, and doubles rounded to five places, so that results compare exactly."""
    kinds = {"int": "long", "smallint": "long", "tinyint": "long", "boolean": "long"}
    fix = lambda c, t: F.round(F.col(c).cast("double"), 5).alias(c) if t in ("double", "float") else F.col(c).cast(kinds[t]).alias(c) if t in kinds else F.col(c)
    return frame.select(*(fix(c, t) for c, t in frame.dtypes))


#: Queries that are registered with the small limits too, as capped_*.
CAPPED = ["posting_cap", "block_exact_full", "block_exact_core", "block_exact_sorted", "block_exact_address", "block_rare_name", "block_rare_address", "block_ranked_rare", "candidates_union", "candidates_topk", "cheap_margin", "tfidf_name_topk", "tfidf_address_topk", "tfidf_blocking_merge", "addr_pool", "addr_pool_capped", "addr_fallback", "addr_preblock_topk", "addr_pool_diagnostics", "fusion_universe2", "fusion_universe3", "fuse_rrf", "fuse_quota", "fuse_naive", "fuse_normalized", "fuse_hybrid", "fuse_rrf3", "fuse_protected3", "rule_score", "macro_f05", "candidate_metrics", "fn_decomposition"]


def catalog(setting: Setting) -> dict:
    """The queries by name; each takes a session and the folder of the tables."""
    CONFIG, K = setting.config, setting.final_k

    def ids(spark: SparkSession, d: str) -> DataFrame:
        return sides(spark, d)[0].select(F.col("entity_id").alias(PAIR[0]))


    def records(spark, d):
        s1, feed = sides(spark, d)
        return s1.unionByName(feed)


    def candidates(spark, d, k=None, config=CONFIG):
        return B.generate_candidates(*sides(spark, d), config, k)


    def name_tfidf(spark, d, config=CONFIG):
        return V.retrieve(*sides(spark, d), "name_core", config.tfidf_k, "name_tfidf", config)


    def address_tfidf(spark, d, config=CONFIG):
        return V.retrieve(*sides(spark, d), "address_full", config.address_k, "address_tfidf", config)


    def universe2(spark, d):
        return R.two_channels(candidates(spark, d), name_tfidf(spark, d), setting.depth)


    def universe3(spark, d):
        return R.three_channels(universe2(spark, d), address_tfidf(spark, d))


    def featured(spark, d, characters=False):
        s1, feed = sides(spark, d)
        return X.pair_features(X.join_records(candidates(spark, d), s1, feed), characters)


    def scored(spark, d):
        return X.rule_score(featured(spark, d), characters=False)


    def labelled(spark, d):
        return E.pair_labels(scored(spark, d), IO.document_truth(spark, d))


    def counted(spark, d, threshold=0.9):
        return E.entity_metrics(E.entity_counts(ids(spark, d), IO.document_truth(spark, d), E.decode(scored(spark, d), "rule_score", threshold)))


    def with_country(frame, spark, d):
        return frame.join(sides(spark, d)[0].select(F.col("entity_id").alias(PAIR[0]), F.col("country_norm").alias("country")), PAIR[0])


    def _block(channel):
        def query(spark, d):
            return B.matched_keys(*sides(spark, d), CONFIG).where(F.col("channel") == channel).select(*PAIR, "key")

        return query


    def _fused(function, *args):
        return lambda spark, d: function(universe2(spark, d), *args).select(*PAIR, "fusion_score", "fusion_rank")


    def _fused3(function, *args):
        return lambda spark, d: function(universe3(spark, d), *args).select(*PAIR, "fusion_score", "fusion_rank", "retrieval_channel_count")


    def gbt(spark, d):
        names = ["name_token_jaccard", "address_token_jaccard", "name_length_ratio", "name_full_exact", "address_exact", "cheap_score", "cheap_rank", "numeric_token_overlap"]
        rows = labelled(spark, d).withColumn("cheap_score", F.col("cheap_score").cast("double"))
        split = S.hash_split(ids(spark, d), 0.25, 7)
        rows = rows.join(split, PAIR[0])
        return M.predict(M.fit(rows.where("not is_validation"), names, rounds=5, min_rows=5), rows).select(*PAIR, "label", "score")


    def truth_lists(spark, d):
        return O.result_frame(ids(spark, d), IO.document_truth(spark, d).withColumn("r", F.lit(0)), "r", "matched_entity_ids")


    def broken_results(spark, d):
        """Result frames with planted faults: a match that is no candidate, and one source row twice."""
        found = candidates(spark, d, 5)
        listed = O.result_frame(ids(spark, d), found, "cheap_rank", "candidate_entity_ids")
        matched = truth_lists(spark, d)
        return O.violations(ids(spark, d), sides(spark, d)[1], matched.unionByName(matched.where("matched_entity_ids <> ''")), listed)


    def pool_diagnostics(spark, d):
        pool = V.address_pool(*sides(spark, d), CONFIG).groupBy(PAIR[0]).agg(F.count(F.lit(1)).alias("n"))
        return E.distribution(ids(spark, d).join(pool, PAIR[0], "left").fillna(0), "n")


    def fn_outcomes(spark, d):
        return E.false_negatives(IO.document_truth(spark, d), candidates(spark, d), E.decode(scored(spark, d), "rule_score", 0.9), sides(spark, d)[0])


    def failures(spark, d):
        s1, feed = sides(spark, d)
        lost = IO.document_truth(spark, d).join(candidates(spark, d, 1).select(*PAIR), PAIR, "left_anti")
        view = lambda frame, s, c: frame.select(F.col("entity_id").alias(c), F.col("name_core").alias(f"{s}_core"), F.col("business_name").alias(f"{s}_raw"), F.col("address_tokens").alias(f"{s}_address"))
        rows = lost.join(view(s1, "l", PAIR[0]), PAIR[0]).join(view(feed, "r", PAIR[1]), PAIR[1])
        rows = rows.withColumns({"charsim": T.character_similarity(F.col("l_core"), F.col("r_core")), "address_jaccard": T.token_jaccard(F.col("l_address"), F.col("r_address")), "raw": F.lower(F.concat_ws(" ", "l_raw", "r_raw"))})
        return rows.groupBy(E.retrieval_failure().alias("category")).agg(F.count(F.lit(1)).alias("links"))


    FLAGS = B.FLAGS
    GRID = [0.5, 0.6, 0.7, 0.8, 0.88, 0.9, 0.93, 0.97]
    EXAMPLE_MODES = [("absolute", 10, 0.0), ("relative", 0, 0.02), ("hybrid", 3, 0.02)]


    def df_modes(spark, d):
        s1, feed = sides(spark, d)
        rows = B.key_counts(B.keyed(feed, CONFIG)).where("channel = 'name_token'").join(B.shard_sizes(feed), "scope")
        out = [rows.where(B.df_eligible(F.col("df"), F.col("shard"), a, r, m)).groupBy("scope").agg(F.count(F.lit(1)).alias("tokens")).withColumn("mode", F.lit(m)) for m, a, r in EXAMPLE_MODES]
        return out[0].unionByName(out[1]).unionByName(out[2])


    def blend(spark, d):
        rows = labelled(spark, d).withColumn("other", F.col("name_token_jaccard"))
        return E.blend_sweep(ids(spark, d), IO.document_truth(spark, d), rows, "rule_score", "other", [0.0, 0.5, 1.0], [0.5, 0.8, 0.9])


    def _stage(name, **options):
        return lambda spark, d: stages.STAGES[name](*sides(spark, d), IO.staged(IO.document_truth(spark, d)), CONFIG, **options)

    def links(spark, d):
        return D.truth_links(IO.document_truth(spark, d), *sides(spark, d))

    def keys_of_links(spark, d):
        return D.link_keys(links(spark, d), *sides(spark, d), CONFIG)

    def split_ids(spark, d):
        return with_country(S.hash_split(ids(spark, d), 0.25, 202603), spark, d)

    def fused2(spark, d):
        return R.reciprocal_rank(universe2(spark, d), K)

    def fused_features(spark, d):
        """Features of the fused pairs, in which the name Jaccard stands for the character ratio."""
        s1, feed = sides(spark, d)
        rows = X.pair_features(X.join_records(fused2(spark, d), s1, feed), False)
        return X.relative_features(rows, {"name_token_jaccard": "name", "address_token_jaccard": "address", "tfidf_similarity": "tfidf", "fusion_score": "fusion"}, "name_token_jaccard")

    def address_extras(spark, d):
        both, far = universe2(spark, d), V.retrieve_preblocked(*sides(spark, d), CONFIG)
        fused = R.protected3(R.three_channels(both, far), K, setting.protect)
        return X.address_extras(fused.select(*PAIR), fused, far).select(*PAIR, *X.ADDRESS_EXTRAS, "relative_address_tfidf_rank", "address_tfidf_gap_to_best")

    def cross_country(spark, d):
        """The cross-country channel on a feed of which every other record has another country."""
        s1, feed = sides(spark, d)
        odd = F.regexp_extract("entity_id", "([0-9]+)$", 1).cast("long") % 2 == 1
        feed = feed.withColumn("country_norm", F.when(odd, F.concat("country_norm", F.lit("x"))).otherwise(F.col("country_norm")))
        return B.matched_keys(s1, feed, CONFIG).where("channel = 'cross'").select(*PAIR, "key")

    def posting_cap_scaled(spark, d):
        scaled = replace(CONFIG, posting_cap=5, name_token_df=15, address_token_df=15, posting_cap_fraction=0.04, posting_cap_max=12)
        feed = sides(spark, d)[1]
        return B.eligible_keys(B.key_counts(B.keyed(feed, scaled)), B.shard_sizes(feed), scaled).groupBy("channel").agg(F.count(F.lit(1)).alias("keys"), F.sum("df").alias("postings"))

    def country_sweep(spark, d):
        rows = E.threshold_sweep(with_country(ids(spark, d), spark, d), IO.document_truth(spark, d), scored(spark, d), "rule_score", M.dense_grid(0.5, 0.98, 25), None, ("country",))
        return E.best_threshold(rows, True, ("country",))

    def blend_by_country(spark, d):
        rows = labelled(spark, d).withColumn("other", F.col("name_token_jaccard"))
        return E.blend_sweep(with_country(ids(spark, d), spark, d), IO.document_truth(spark, d), rows, "rule_score", "other", [0.0, 0.25, 1.0], [0.5, 0.8, 0.9], ("country",))

    def fusion_grid(spark, d):
        some = [v for v in stages.fusion_variants((20, 30)) if v[0] in ("quota 50=35+15", "rrf 2:1/20", "normalized 0.7:0.3+0.1", "hybrid 50>=35") and v[2] == 50]
        return stages.fusion_sweep(*sides(spark, d), IO.staged(IO.document_truth(spark, d)), CONFIG, some)

    def two_models(spark, d):
        rows = labelled(spark, d).withColumn("cheap_score", F.col("cheap_score").cast("double")).join(S.hash_split(ids(spark, d), 0.25, 7), PAIR[0])
        names = ["name_token_jaccard", "address_token_jaccard", "name_length_ratio", "cheap_score", "numeric_token_overlap"]
        found = M.fit_second(rows.where("not is_validation"), names, trees=10)
        gains = spark.createDataFrame(M.importances(found, names), "feature string, gain double")
        return D.importance_change(spark.createDataFrame(M.importances(M.fit(rows.where("not is_validation"), names, rounds=3, min_rows=5), names), "feature string, gain double"), gains)


    return {
        "normalize_names": lambda s, d: records(s, d).select("entity_id", "name_full", "name_core", "name_sorted", "name_acronym"),
        "normalize_addresses": lambda s, d: records(s, d).select("entity_id", "address_full", "country_norm"),
        "legal_forms": lambda s, d: records(s, d).groupBy("legal_form").agg(F.count(F.lit(1)).alias("n")),
        "numeric_tokens": lambda s, d: records(s, d).select("entity_id", F.array_join("address_numeric_tokens", " ").alias("numbers")),
        "postcode_extract": lambda s, d: records(s, d).select("entity_id", "postcode"),
        "informative_tokens": lambda s, d: records(s, d).select("entity_id", F.array_join(F.array_sort(T.informative(F.col("name_tokens"))), " ").alias("words")),
        "char_ngrams": lambda s, d: V.gram_counts(sides(s, d)[0], "name_core", CONFIG).groupBy("country", "gram").agg(F.sum("tf").alias("n")),
        "source_violations": lambda s, d: IO.source_violations(sides(s, d)[1], "S2-"),
        "truth_explode": lambda s, d: IO.explode_truth(truth_lists(s, d)),
        "shard_sizes": lambda s, d: B.shard_sizes(sides(s, d)[1]),
        "token_df": lambda s, d: B.key_counts(B.keyed(sides(s, d)[1], CONFIG)).where("channel = 'name_token'").select("scope", "key", "df"),
        "df_eligibility_modes": df_modes,
        "posting_cap": lambda s, d: B.eligible_keys(B.key_counts(B.keyed(sides(s, d)[1], CONFIG)), B.shard_sizes(sides(s, d)[1]), CONFIG).groupBy("channel").agg(F.count(F.lit(1)).alias("keys"), F.sum("df").alias("postings")),
        "block_exact_full": _block("full"),
        "block_exact_core": _block("core"),
        "block_exact_sorted": _block("sorted"),
        "block_exact_address": _block("address"),
        "block_cross_country": cross_country,
        "posting_cap_scaled": posting_cap_scaled,
        "truth_links": lambda s, d: links(s, d).select(*PAIR, "country", "candidate_country", "bucket", F.col("l_name_core").alias("left_name"), F.col("r_name_core").alias("right_name")),
        "channel_diagnosis": lambda s, d: D.channel_diagnosis(links(s, d), keys_of_links(s, d)),
        "suppressed_postings": lambda s, d: D.suppressed_postings(keys_of_links(s, d)),
        "retrieval_bundle": lambda s, d: D.retrieval_bundle(split_ids(s, d), IO.document_truth(s, d), fused2(s, d)),
        "label_metrics": lambda s, d: D.label_metrics(labelled(s, d), IO.document_truth(s, d), sides(s, d)[0]),
        "pair_summary": lambda s, d: D.pair_summary(labelled(s, d)),
        "probability_metrics": lambda s, d: E.probability_metrics(labelled(s, d), "rule_score"),
        "truth_distribution": lambda s, d: D.truth_distribution(ids(s, d), IO.document_truth(s, d)),
        "dense_sweep": lambda s, d: E.best_threshold(E.threshold_sweep(ids(s, d), IO.document_truth(s, d), scored(s, d), "rule_score", M.dense_grid()), True),
        "probability_threshold": lambda s, d: E.best_threshold(E.threshold_sweep(ids(s, d), IO.document_truth(s, d), scored(s, d), "rule_score", M.probability_grid())),
        "country_sweep": country_sweep,
        "blend_by_country": blend_by_country,
        "fused_relative_features": lambda s, d: fused_features(s, d).select(*PAIR, "relative_name_rank", "relative_address_rank", "relative_tfidf_rank", "relative_fusion_rank", "name_top_margin", "address_top_margin", "tfidf_top_margin", "fusion_gap_to_best", "close_competitor_count"),
        "address_extras": address_extras,
        "displaced_links": lambda s, d: D.displaced_links(IO.document_truth(s, d), universe2(s, d), R.quota(universe2(s, d), 4, 2, 2), fused2(s, d)),
        "blocked_out": lambda s, d: D.blocked_out(IO.document_truth(s, d), candidates(s, d, 1), name_tfidf(s, d)),
        "error_examples": lambda s, d: D.examples(E.decode(labelled(s, d), "rule_score", 0.5).where("label = 0").select(*PAIR, "rule_score"), 15, F.desc("rule_score")),
        "link_outcomes": lambda s, d: D.link_outcomes(IO.document_truth(s, d), candidates=candidates(s, d), near=name_tfidf(s, d)).groupBy("candidates", "near").agg(F.count(F.lit(1)).alias("links")),
        "fusion_grid": fusion_grid,
        "importance_change": two_models,
        "block_rare_name": _block("name_token"),
        "block_rare_address": _block("address_token"),
        "block_ranked_rare": lambda s, d: B.ranked_name_tokens(B.keyed(sides(s, d)[0], CONFIG), B.key_counts(B.keyed(sides(s, d)[1], CONFIG)), B.shard_sizes(sides(s, d)[1]), replace(CONFIG, ranked_name_tokens=2)).select("entity_id", "key"),
        "candidates_union": lambda s, d: B.pair_support(B.matched_keys(*sides(s, d), CONFIG)).select(*PAIR, *FLAGS, "rare_name_token_hits", "rare_address_token_hits", "same_country_block"),
        "candidates_topk": lambda s, d: candidates(s, d).select(*PAIR, "cheap_score", "cheap_rank", "raw_candidate_count", "final_candidate_count", "candidate_source"),
        "candidates_at_k": lambda s, d: B.candidates_at_k(candidates(s, d), 3).select(*PAIR, "cheap_rank", "final_candidate_count"),
        "cheap_margin": lambda s, d: candidates(s, d).select(*PAIR, "cheap_score_margin_to_next"),
        "tfidf_name_topk": lambda s, d: name_tfidf(s, d).select(*PAIR, "name_tfidf_similarity", "name_tfidf_rank"),
        "tfidf_address_topk": lambda s, d: address_tfidf(s, d).select(*PAIR, "address_tfidf_similarity", "address_tfidf_rank"),
        "tfidf_vocab_cap": lambda s, d: V.vocabulary(sides(s, d)[1], "name_core", replace(CONFIG, max_features=50)).select("country", "gram", "df", "idf"),
        "tfidf_blocking_merge": lambda s, d: B.generate_candidates(*sides(s, d), CONFIG, None, name_tfidf(s, d)).select(*PAIR, "block_name_tfidf", "name_tfidf_similarity", "cheap_rank"),
        "addr_pool": lambda s, d: V.address_pool(*sides(s, d), replace(CONFIG, pool_cap=1 << 30)).select(*PAIR, "route_mask", "least_df", "pool_size"),
        "addr_pool_capped": lambda s, d: V.address_pool(*sides(s, d), CONFIG, ("postcode", "postcode_prefix", "numeric", "rare_token")).select(*PAIR, "route_mask", "least_df"),
        "addr_fallback": lambda s, d: V.fallback_pool(*sides(s, d), V.address_pool(*sides(s, d), CONFIG, ("postcode",)), CONFIG),
        "addr_preblock_topk": lambda s, d: V.retrieve_preblocked(*sides(s, d), CONFIG).select(*PAIR, "address_tfidf_similarity", "address_tfidf_rank", "address_route_count"),
        "addr_pool_diagnostics": pool_diagnostics,
        "fusion_universe2": lambda s, d: universe2(s, d).select(*PAIR, "legacy_rank", "legacy_score", "tfidf_rank", "is_legacy_only", "is_tfidf_only", "supported_by_both"),
        "fusion_universe3": lambda s, d: universe3(s, d).select(*PAIR, "legacy_rank", "tfidf_rank", "address_rank", "retrieval_channel_count"),
        "fuse_rrf": _fused(R.reciprocal_rank, K),
        "fuse_quota": _fused(R.quota, K, setting.legacy_quota, setting.tfidf_quota),
        "fuse_naive": _fused(R.naive_score, K),
        "fuse_normalized": _fused(R.normalized_score, K),
        "fuse_hybrid": _fused(R.hybrid, K, setting.protect),
        "fuse_rrf3": _fused3(R.reciprocal_rank3, K),
        "fuse_protected3": _fused3(R.protected3, K, setting.protect),
        "pair_features": lambda s, d: featured(s, d).drop(*FLAGS, "block_name_tfidf", "name_tfidf_similarity", "name_tfidf_rank", "rare_name_token_hits", "rare_address_token_hits", "same_country_block", "cheap_score", "raw_candidate_count", "final_candidate_count", "cheap_score_margin_to_next", "candidate_source"),
        "char_similarity": lambda s, d: featured(s, d, True).select(*PAIR, "name_character_similarity"),
        "relative_features": lambda s, d: X.relative_features(featured(s, d), {"name_token_jaccard": "name", "address_token_jaccard": "address"}, "name_token_jaccard").select(*PAIR, "relative_name_rank", "name_top_margin", "name_gap_to_best", "relative_address_rank", "address_top_margin", "close_competitor_count"),
        "rule_score": lambda s, d: scored(s, d).select(*PAIR, "rule_score"),
        "rule_score_full": lambda s, d: X.rule_score(featured(s, d, True)).select(*PAIR, "rule_score"),
        "pair_labels": lambda s, d: labelled(s, d).select(*PAIR, "label"),
        "hard_negatives": lambda s, d: S.hard_negatives(labelled(s, d), 1.0 / (1.0 + F.col("cheap_rank")) + F.col("address_token_jaccard") * 0.15, 2).select(*PAIR, "label"),
        "entity_split": lambda s, d: S.entity_split(ids(s, d), 0.25, 202603),
        "hash_split": lambda s, d: S.hash_split(ids(s, d), 0.25, 202603),
        "density_nested": lambda s, d: S.density(S.distractor_ranks(sides(s, d)[1], IO.document_truth(s, d), 202604), 100).select("entity_id", "feed_source", "distractor_rank"),
        "bounded_universe": lambda s, d: S.bounded_universe(sides(s, d)[1], IO.document_truth(s, d), 50).select("entity_id"),
        "entity_f05": lambda s, d: counted(s, d).select(PAIR[0], "tp", "n_predicted", "n_true", "f05"),
        "macro_f05": lambda s, d: E.summary(counted(s, d)),
        "f05_by_country": lambda s, d: E.summary(with_country(counted(s, d), s, d), "country").select("country", "entities", "macro_f05"),
        "f05_by_bucket": lambda s, d: E.summary(counted(s, d).withColumn("bucket", E.truth_bucket()), "bucket").select("bucket", "entities", "macro_f05"),
        "candidate_metrics": lambda s, d: E.candidate_metrics(ids(s, d), IO.document_truth(s, d), candidates(s, d)),
        "blocker_recovery": lambda s, d: E.channel_recovery(labelled(s, d), FLAGS),
        "channel_overlap": lambda s, d: E.channel_overlap(labelled(s, d), FLAGS),
        "threshold_sweep": lambda s, d: E.threshold_sweep(ids(s, d), IO.document_truth(s, d), scored(s, d), "rule_score", GRID),
        "rule_threshold": lambda s, d: E.best_threshold(E.threshold_sweep(ids(s, d), IO.document_truth(s, d), scored(s, d), "rule_score", list(RULE_THRESHOLDS))),
        "country_thresholds": lambda s, d: E.decode(with_country(scored(s, d), s, d), "rule_score", 0.9, {"en": 0.95, "fr": 0.85}).select(*PAIR, "rule_score"),
        "blend_sweep": blend,
        "model_disagreement": lambda s, d: E.disagreement(labelled(s, d), F.col("rule_score") >= 0.9, F.col("name_token_jaccard") >= 0.8),
        "fn_decomposition": fn_outcomes,
        "fp_taxonomy": lambda s, d: E.decode(labelled(s, d), "rule_score", 0.5).where("label = 0").groupBy(E.false_positive_pattern().alias("pattern")).agg(F.count(F.lit(1)).alias("pairs")),
        "failure_taxonomy": failures,
        "average_precision": lambda s, d: E.average_precision(labelled(s, d), "rule_score"),
        "score_distribution": lambda s, d: E.distribution(labelled(s, d), "rule_score", "label"),
        "submission_matching": truth_lists,
        "submission_candidates": lambda s, d: O.result_frame(ids(s, d), candidates(s, d, 5), "cheap_rank", "candidate_entity_ids"),
        "submission_violations": broken_results,
        "gbt_scores": gbt,
        "stage_rules": _stage("rules"),
        "stage_retrieval_union": _stage("e1"),
        "stage_density": _stage("e2.1", totals=(100, 400)),
        "stage_token_policies": _stage("e2.2"),
        "stage_preblocked": _stage("e2.3"),
        "stage_boosted_trees": _stage("e2", rounds=3),
        "stage_ensemble": _stage("e2.4", rounds=2, trees=5, alphas=3),
        "stage_smoke": _stage("smoke", distractors=100),
        "pool_sizes": lambda s, d: stages.pool_sizes(*sides(s, d), CONFIG),
    }


def queries() -> dict:
    every = {**catalog(DEFAULT), **{f"capped_{k}": f for k, f in catalog(SMALL).items() if k in CAPPED}}
    return {name: lambda s, d, f=f: tidy(f(s, d)) for name, f in every.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every source record its ten best feed candidates."""
    top = B.generate_candidates(*sides(spark, sf_dir), DEFAULT.config, 10)
    return tidy(top.select(*PAIR, "cheap_score", "cheap_rank"))
