"""Composite experiments: rules, retrieval union, fusion grid, boosted trees, density stress, channel repair, pre-blocked addresses, blends.

Each stage takes the normalised source and feed, the truth links and the parameters, and returns a small table of
metrics, one row a variant. What its variants share is written to the shared folder once, and read by each.
"""

from __future__ import annotations

import time
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkforge.config import RULE_THRESHOLDS, LinkConfig
from linkforge.operators import blocking, diagnosis, evaluation, features, fusion, model, sampling, submission, tfidf
from linkforge.sources import records

PAIR = blocking.PAIR
#: The rare-token policies compared by the blocking experiment.
POLICIES = {
    "absolute_baseline": {},
    "relative_df": {"df_mode": "relative", "name_df_fraction": 0.0005, "address_df_fraction": 0.00015},
    "hybrid_df": {"df_mode": "hybrid", "name_df_fraction": 0.0005, "address_df_fraction": 0.00015},
    "hybrid_scaled_postings": {"df_mode": "hybrid", "name_df_fraction": 0.0005, "address_df_fraction": 0.00015, "posting_cap_fraction": 0.0006, "posting_cap_max": 350},
    "hybrid_ranked2_scaled": {"df_mode": "hybrid", "name_df_fraction": 0.0005, "address_df_fraction": 0.00015, "posting_cap_fraction": 0.0006, "posting_cap_max": 350, "ranked_name_tokens": 2},
}
#: The fusion grid, (final K, ...) for each strategy.
DEPTHS, FINAL_KS = (20, 30, 50), (30, 40, 50, 75)
QUOTAS = ((30, 20, 10), (30, 24, 6), (40, 30, 10), (40, 32, 8), (50, 35, 15), (50, 40, 10), (50, 45, 5), (75, 50, 25))
RRF = ((2.0, 1.0, 20.0), (3.0, 1.0, 20.0), (3.0, 1.0, 60.0))
NORMALIZED = ((0.70, 0.30, 0.10), (0.80, 0.20, 0.10), (0.65, 0.35, 0.15))
HYBRID = ((30, 20), (30, 24), (40, 30), (40, 32), (50, 35), (50, 40), (50, 45), (75, 50))
#: The pre-blocking strategies; the first is only diagnosed.
STRATEGIES = {
    "postcode_numeric": (("postcode", "numeric"), {"numeric_max_df": 2_000, "rare_token_max_df": 250, "rare_tokens_per_query": 0, "pool_cap": 10_000}),
    "balanced_union": (("postcode", "numeric", "rare_token"), {"numeric_max_df": 2_000, "rare_token_max_df": 250, "rare_tokens_per_query": 2, "pool_cap": 10_000}),
    "balanced_prefix_union": (("postcode", "postcode_prefix", "numeric", "rare_token"), {"prefix_max_df": 2_000, "numeric_max_df": 2_000, "rare_token_max_df": 250, "rare_tokens_per_query": 2, "pool_cap": 10_000}),
    "broad_union": (("postcode", "numeric", "rare_token"), {"numeric_max_df": 5_000, "rare_token_max_df": 500, "rare_tokens_per_query": 3, "pool_cap": 15_000}),
}
MODEL_FEATURES = [
    "name_full_exact", "name_core_exact", "name_sorted_exact", "address_exact", "name_token_jaccard", "address_token_jaccard", "name_shared_token_count", "address_shared_token_count", "name_token_count_difference",
    "name_length_ratio", "address_length_ratio", "name_character_similarity", "name_prefix_ratio", "name_suffix_ratio", "numeric_token_equal", "numeric_token_overlap", "numeric_token_conflict", "address_missing_left",
    "address_missing_right", "country_missing_left", "country_missing_right", "same_country", "country_conflict", "both_country_present", "source_is_s2", "source_is_s3", "legacy_rank", "legacy_score", "tfidf_rank", "tfidf_similarity",
    "is_legacy_only", "is_tfidf_only", "supported_by_both", "fusion_score", "fusion_rank", "relative_name_rank", "relative_address_rank", "relative_tfidf_rank", "relative_fusion_rank", "name_top_margin", "address_top_margin",
    "tfidf_top_margin", "fusion_gap_to_best", "close_competitor_count",
]
RELATIVE = {"name_character_similarity": "name", "address_token_jaccard": "address", "tfidf_similarity": "tfidf", "fusion_score": "fusion"}


def _ids(source: DataFrame) -> DataFrame:
    return source.select(F.col("entity_id").alias(PAIR[0]))


def _stack(rows: list[tuple[str, DataFrame]]) -> DataFrame:
    out = None
    for name, frame in rows:
        frame = frame.withColumn("variant", F.lit(name))
        out = frame if out is None else out.unionByName(frame)
    return out


def _near(source: DataFrame, feed: DataFrame, config: LinkConfig) -> DataFrame:
    return tfidf.retrieve(source, feed, "name_core", config.tfidf_k, "name_tfidf", config)


def _legacy(source: DataFrame, feed: DataFrame, config: LinkConfig) -> DataFrame:
    return blocking.generate_candidates(source, feed, config, max(50, config.candidate_k))


def rules(source: DataFrame, feed: DataFrame, truth: DataFrame, config: LinkConfig, depths: tuple[int, ...] = (10, 20, 30, 50)) -> DataFrame:
    """Blocking at several depths, then the rule score with its threshold tuned at the smallest sufficient depth."""
    found = records.staged(blocking.generate_candidates(source, feed, config, max(depths)))
    metrics = [(str(k), evaluation.candidate_metrics(_ids(source), truth, blocking.candidates_at_k(found, k))) for k in depths]
    recalls = [(int(r.variant), r.pair_recall) for r in _stack(metrics).collect()]
    best = blocking.smallest_sufficient(recalls, 0.0005)
    scored = features.rule_score(features.pair_features(features.join_records(blocking.candidates_at_k(found, best), source, feed)))
    sweep = evaluation.threshold_sweep(_ids(source), truth, scored, "rule_score", list(RULE_THRESHOLDS))
    return evaluation.best_threshold(sweep).withColumn("candidate_k", F.lit(best))


def retrieval_union(source: DataFrame, feed: DataFrame, truth: DataFrame, config: LinkConfig, depths: tuple[int, ...] = (20, 30, 50, 75, 100)) -> DataFrame:
    """Candidate metrics with and without the name TF-IDF channel."""
    near = records.staged(_near(source, feed, config))
    plain, merged = (records.staged(blocking.generate_candidates(source, feed, config, max(depths), x)) for x in (None, near))
    rows = [(f"{name}@{k}", evaluation.candidate_metrics(_ids(source), truth, blocking.candidates_at_k(c, k))) for name, c in (("blocking", plain), ("union", merged)) for k in depths]
    return _stack(rows)


def fusion_variants(depths: tuple[int, ...] = DEPTHS) -> list[tuple[str, int, int, object]]:
    """(name, TF-IDF depth, final K, function of the universe) of the whole grid."""
    out: list[tuple[str, int, int, object]] = []
    for depth in depths:
        out += [(f"quota {k}={a}+{b}", depth, k, lambda u, k=k, a=a, b=b: fusion.quota(u, k, a, b)) for k, a, b in QUOTAS]
        out += [(f"rrf {a:g}:{b:g}/{c:g}", depth, k, lambda u, k=k, a=a, b=b, c=c: fusion.reciprocal_rank(u, k, a, b, c)) for a, b, c in RRF for k in FINAL_KS]
        out += [(f"normalized {a:g}:{b:g}+{c:g}", depth, k, lambda u, k=k, a=a, b=b, c=c: fusion.normalized_score(u, k, a, b, c)) for a, b, c in NORMALIZED for k in FINAL_KS]
        out += [(f"hybrid {k}>={a}", depth, k, lambda u, k=k, a=a: fusion.hybrid(u, k, a)) for k, a in HYBRID]
    return out


def fusion_sweep(source: DataFrame, feed: DataFrame, truth: DataFrame, config: LinkConfig, variants: list | None = None) -> DataFrame:
    """A record for each variant of the fusion grid: metrics, kept and displaced true links; ``best`` marks the one that is selected."""
    legacy, near = records.staged(_legacy(source, feed, config)), records.staged(_near(source, feed, config))
    variants = fusion_variants() if variants is None else variants
    universes = {depth: records.staged(fusion.two_channels(legacy, near, depth)) for depth in sorted({v[1] for v in variants})}
    out = None
    for name, depth, final_k, fuse in variants:
        shallow = near.where(F.col("name_tfidf_rank") <= depth)
        one = diagnosis.fusion_record(_ids(source), truth, legacy, shallow, fuse(universes[depth])).withColumns({"variant": F.lit(name), "depth": F.lit(depth), "final_k": F.lit(final_k)})
        one = records.staged(one)  # each variant is a job of its own, so no plan holds the whole grid
        out = one if out is None else out.unionByName(one)
    best = diagnosis.best_fusion(out).select("variant", "depth", "final_k").withColumn("best", F.lit(1))
    return out.join(best, ["variant", "depth", "final_k"], "left").fillna(0, ["best"])


def model_rows(source: DataFrame, feed: DataFrame, truth: DataFrame, config: LinkConfig, seed: int = 202603, fraction: float = 0.25) -> DataFrame:
    """Fused candidates with all features, label, and the entity-disjoint split."""
    fused = fusion.reciprocal_rank(fusion.two_channels(_legacy(source, feed, config), _near(source, feed, config), 30), 50)
    rows = evaluation.pair_labels(features.pair_features(features.join_records(fused, source, feed)), truth)
    rows = features.relative_features(rows, RELATIVE, "name_character_similarity", config.close_tolerance)
    return rows.join(sampling.entity_split(_ids(source), fraction, seed), PAIR[0])


def held_out(rows: DataFrame, truth: DataFrame, scored: DataFrame) -> DataFrame:
    """The tuned threshold of held-out entities: the coarse grid, then the fine one around its best."""
    ids = rows.where("is_validation").select(PAIR[0]).distinct()
    held = truth.join(ids, PAIR[0], "left_semi")
    sweep = lambda grid: evaluation.best_threshold(evaluation.threshold_sweep(ids, held, scored, "score", grid))
    return sweep(model.probability_grid(sweep(model.probability_grid()).first().threshold))


def boosted_trees(source: DataFrame, feed: DataFrame, truth: DataFrame, config: LinkConfig, rounds: int = 50) -> DataFrame:
    """Boosted trees on all negatives, and on five hard ones a positive: tuned threshold and probability metrics of held-out entities."""
    rows = records.staged(model_rows(source, feed, truth, config))
    train, out = rows.where("not is_validation"), []
    hardness = 1.0 / (1.0 + F.col("fusion_rank")) + F.col("name_character_similarity") * 0.2
    for name, some in (("all_negatives", train), ("hard_negatives", sampling.hard_negatives(train, hardness, config.hard_negatives))):
        scored = records.staged(model.predict(model.fit(some, MODEL_FEATURES, rounds=rounds, seed=42), rows.where("is_validation")).select(*PAIR, "label", "score"))
        one = held_out(rows, truth, scored).withColumn("_one", F.lit(1)).join(evaluation.probability_metrics(scored).withColumn("_one", F.lit(1)), "_one").drop("_one")
        out.append((name, one))
    return _stack(out)


def ensemble(source: DataFrame, feed: DataFrame, truth: DataFrame, config: LinkConfig, rounds: int = 30, trees: int = 100, alphas: int = 21) -> DataFrame:
    """Boosted trees blended with a forest: the best threshold of a dense grid for each share of the former, overall and by country."""
    rows = records.staged(model_rows(source, feed, truth, config))
    train, test = rows.where("not is_validation"), rows.where("is_validation")
    first = model.predict(model.fit(train, MODEL_FEATURES, rounds=rounds), test).select(*PAIR, "label", F.col("score").alias("first"))
    second = model.predict(model.fit_second(train, MODEL_FEATURES, trees), test).select(*PAIR, F.col("score").alias("second"))
    both = records.staged(first.join(second, PAIR))
    ids = test.select(PAIR[0]).distinct().join(source.select(F.col("entity_id").alias(PAIR[0]), F.col("country_norm").alias("country")), PAIR[0])
    held = truth.join(ids, PAIR[0], "left_semi")
    shares, grid = [i / (alphas - 1) for i in range(alphas)], model.dense_grid()
    whole = evaluation.best_threshold(evaluation.blend_sweep(ids, held, both, "first", "second", shares, grid), True, ("alpha",))
    each = evaluation.best_threshold(evaluation.blend_sweep(ids, held, both, "first", "second", shares, grid, ("country",)), True, ("alpha", "country"))
    return whole.withColumn("country", F.lit("all")).unionByName(each)


def density_stress(source: DataFrame, feed: DataFrame, truth: DataFrame, config: LinkConfig, totals: tuple[int, ...] = (100_000, 500_000, 1_000_000), seed: int = 202604) -> DataFrame:
    """Fused candidates of frozen parameters over the linked feed records and nested numbers of others."""
    linked = feed.join(truth.select(F.col("candidate_entity_id").alias("entity_id")).distinct(), "entity_id", "left_semi")
    ranked = records.staged(sampling.distractor_ranks(feed, truth, seed))
    rows = []
    for total in totals:
        some = linked.unionByName(sampling.density(ranked, total).select(*feed.columns))
        fused = fusion.reciprocal_rank(fusion.two_channels(_legacy(source, some, config), _near(source, some, config), 30), 50)
        rows.append((str(total), records.staged(evaluation.candidate_metrics(_ids(source), truth, fused))))
    return _stack(rows)


def token_policies(source: DataFrame, feed: DataFrame, truth: DataFrame, config: LinkConfig, k: int = 50) -> DataFrame:
    return _stack([(n, evaluation.candidate_metrics(_ids(source), truth, blocking.generate_candidates(source, feed, replace(config, **p), k))) for n, p in POLICIES.items()])


def preblocked(source: DataFrame, feed: DataFrame, truth: DataFrame, config: LinkConfig, final_k: int = 50, protect: int = 35, tops: tuple[int, ...] = (10, 20)) -> DataFrame:
    """Three channels with protected legacy candidates, for each pre-blocking strategy and address depth; the first strategy's pools are only counted."""
    both = records.staged(fusion.two_channels(_legacy(source, feed, config), _near(source, feed, config), 30))
    vocab = records.staged(tfidf.vocabulary(feed.where("address_full <> ''"), "address_full", config))  # no strategy changes its limits
    rows = []
    for name, (routes, limits) in list(STRATEGIES.items())[1:]:
        far = records.staged(tfidf.retrieve_preblocked(source, feed, replace(config, address_k=max(tops), **limits), routes, vocab=vocab))
        for top in tops:
            fused = fusion.protected3(fusion.three_channels(both, far.where(F.col("address_tfidf_rank") <= top)), final_k, protect)
            rows.append((f"{name}@{top}", records.staged(evaluation.candidate_metrics(_ids(source), truth, fused))))
    return _stack(rows)


def pool_sizes(source: DataFrame, feed: DataFrame, config: LinkConfig) -> DataFrame:
    """Distribution of the pools' sizes of every pre-blocking strategy, and how many records have none."""
    rows = []
    for name, (routes, limits) in STRATEGIES.items():
        pool = tfidf.address_pool(source, feed, replace(config, **limits), routes).groupBy(PAIR[0]).agg(F.count(F.lit(1)).alias("n"))
        sizes = _ids(source).join(pool, PAIR[0], "left").fillna(0)
        rows.append((name, evaluation.distribution(sizes, "n").withColumn("_one", F.lit(1)).join(sizes.agg(F.count_if(F.col("n") == 0).alias("empty")).withColumn("_one", F.lit(1)), "_one").drop("_one")))
    return _stack(rows)


def submit(source: DataFrame, feed: DataFrame, config: LinkConfig, folder: str, threshold: float = 0.70) -> tuple[str, str]:
    """Candidates, rule score and decision of all source records, checked and written as the two result files."""
    found = records.staged(blocking.generate_candidates(source, feed, config))
    scored = features.rule_score(features.pair_features(features.join_records(found, source, feed)))
    matched, listed = submission.result_frames(_ids(source), found, evaluation.decode(scored, "rule_score", threshold))
    return submission.write_submission(_ids(source), feed, matched, listed, folder)


def smoke(source: DataFrame, feed: DataFrame, truth: DataFrame, config: LinkConfig, entities: int = 50, distractors: int = 500) -> DataFrame:
    """The rules stage, and the checks of its result frames, on the first entities and a bounded feed: ``(problem, rows)``, all 0 if it passed."""
    ids = sampling.first_entities(_ids(source), entities, 42)
    some = source.join(ids.withColumnRenamed(PAIR[0], "entity_id"), "entity_id", "left_semi")
    links = truth.join(ids, PAIR[0], "left_semi")
    few = sampling.bounded_universe(feed, links, 2 * distractors)
    found = records.staged(blocking.generate_candidates(some, few, config))
    scored = features.rule_score(features.pair_features(features.join_records(found, some, few)))
    matched, listed = submission.result_frames(ids, found, evaluation.decode(scored, "rule_score", 0.70))
    return submission.violations(ids, few, matched, listed)


def evaluate(source: DataFrame, feed: DataFrame, truth: DataFrame, config: LinkConfig, folder: str, threshold: float = 0.70) -> dict:
    """The whole rules run: artifacts and a JSON report of candidate metrics, decisions by country and bucket, and seconds a step, under ``folder``."""
    spark, began, seconds = source.sparkSession, time.time(), {}

    def done(step: str) -> None:
        nonlocal began
        seconds[step], began = round(time.time() - began, 3), time.time()
        records.event(step, seconds=seconds[step])

    meta = {"fingerprint": config.fingerprint()}
    records.write_artifacts({"source": source, "feed": feed}, folder, meta)
    done("normalized")
    records.write_artifacts({"candidates": blocking.generate_candidates(source, feed, config)}, folder, meta)
    found = records.read_cache(spark, f"{folder}/candidates", meta["fingerprint"])
    done("candidates")
    scored = features.rule_score(features.pair_features(features.join_records(found, source, feed)))
    records.write_artifacts({"features": evaluation.pair_labels(scored, truth)}, folder, meta)
    scored = records.read_cache(spark, f"{folder}/features", meta["fingerprint"])
    done("features")
    ids = source.select(F.col("entity_id").alias(PAIR[0]), F.col("country_norm").alias("country"))
    counted = evaluation.entity_metrics(evaluation.entity_counts(ids, truth, evaluation.decode(scored, "rule_score", threshold))).withColumn("bucket", evaluation.truth_bucket())
    rows = lambda frame: [r.asDict() for r in frame.collect()]
    report = {"config": meta, "threshold": threshold, "candidates": rows(evaluation.candidate_metrics(ids, truth, found)), "overall": rows(evaluation.summary(counted)), "by_country": rows(evaluation.summary(counted, "country")), "by_bucket": rows(evaluation.summary(counted, "bucket")), "labels": rows(diagnosis.label_metrics(scored, truth, source))}
    done("evaluated")
    report["seconds"] = seconds
    records.write_report(spark, report, f"{folder}/report")
    return report


STAGES = {"rules": rules, "e1": retrieval_union, "e1.1": fusion_sweep, "e2": boosted_trees, "e2.1": density_stress, "e2.2": token_policies, "e2.3": preblocked, "e2.4": ensemble, "smoke": smoke}
