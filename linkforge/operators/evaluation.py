"""Labels, decisions, set-valued F0.5, candidate metrics, sweeps, taxonomies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PAIR = ["source1_entity_id", "candidate_entity_id"]


def pair_labels(pairs: DataFrame, truth: DataFrame) -> DataFrame:
    return pairs.join(truth.select(*PAIR).distinct().withColumn("label", F.lit(1)), PAIR, "left").fillna(0, ["label"])


def f05(tp: Column, predicted: Column, true: Column) -> Column:
    """F0.5 of one entity; two empty sets agree fully, one empty set scores 0."""
    return F.when((predicted == 0) & (true == 0), 1.0).otherwise(1.25 * tp / (1.25 * tp + 0.25 * (true - tp) + (predicted - tp)))


def entity_counts(ids: DataFrame, truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """``tp, n_predicted, n_true`` of every id of ``ids``, those without any pairs included."""
    pairs = predicted.select(*PAIR).distinct().withColumn("p", F.lit(1)).join(truth.select(*PAIR).distinct().withColumn("t", F.lit(1)), PAIR, "full_outer")
    sums = pairs.groupBy(PAIR[0]).agg(F.count(F.col("p") + F.col("t")).alias("tp"), F.count("p").alias("n_predicted"), F.count("t").alias("n_true"))
    return ids.join(sums, PAIR[0], "left").fillna(0)


def entity_metrics(counts: DataFrame) -> DataFrame:
    share = lambda n: F.when((F.col("n_predicted") == 0) & (F.col("n_true") == 0), 1.0).when(F.col(n) == 0, 0.0).otherwise(F.col("tp") / F.col(n))
    return counts.withColumns({"precision": share("n_predicted"), "recall": share("n_true"), "f05": f05(F.col("tp"), F.col("n_predicted"), F.col("n_true"))})


def summary(metrics: DataFrame, *by: str) -> DataFrame:
    """Macro and micro averages, overall or by columns; micro precision without predictions is 0, micro recall without truth 1."""
    tp, p, t = (F.sum(c) for c in ("tp", "n_predicted", "n_true"))
    return metrics.groupBy(*by).agg(
        F.count(F.lit(1)).alias("entities"), F.avg("precision").alias("macro_precision"), F.avg("recall").alias("macro_recall"), F.avg("f05").alias("macro_f05"),
        F.when(p == 0, 0.0).otherwise(tp / p).alias("micro_precision"), F.when(t == 0, 1.0).otherwise(tp / t).alias("micro_recall"), F.count_if(F.col("n_predicted") == 0).alias("empty_predictions"), tp.alias("true_positives"),
    )


def truth_bucket(n: str = "n_true") -> Column:
    return F.when(F.col(n) >= 3, "3+").otherwise(F.col(n).cast("string"))


def candidate_metrics(ids: DataFrame, truth: DataFrame, candidates: DataFrame, *by: str) -> DataFrame:
    """Recall of pairs and entities, the best reachable F0.5, and the distribution of candidate counts; overall or by columns of ``ids``."""
    counts = entity_counts(ids, truth, candidates).withColumn("oracle", f05(F.col("tp"), F.col("tp"), F.col("n_true")))
    recall = F.when(F.col("n_true") == 0, 1.0).otherwise(F.col("tp") / F.col("n_true"))
    n = F.col("n_predicted")
    return counts.groupBy(*by).agg(F.when(F.sum("n_true") == 0, 1.0).otherwise(F.sum("tp") / F.sum("n_true")).alias("pair_recall"), F.avg(recall).alias("entity_recall"), F.avg("oracle").alias("oracle_f05"), F.avg(n).alias("mean_candidates"), F.percentile(n, F.lit(0.5)).alias("median_candidates"), F.percentile(n, F.lit(0.95)).alias("p95_candidates"), F.max(n).alias("max_candidates"))


def channel_recovery(labelled: DataFrame, flags: list[str]) -> DataFrame:
    """``(channel, recovered, unique)``: true links each channel finds, and those that no other finds."""
    total = sum((F.col(f) for f in flags), F.lit(0))
    sums = labelled.where("label = 1").agg(*(F.sum(f).alias(f) for f in flags), *(F.sum(F.when(total == 1, F.col(f)).otherwise(0)).alias(f"u_{f}") for f in flags))
    return sums.select(F.explode(F.array(*(F.struct(F.lit(f).alias("channel"), F.coalesce(F.col(f), F.lit(0)).cast("long").alias("recovered"), F.coalesce(F.col(f"u_{f}"), F.lit(0)).cast("long").alias("unique_links")) for f in flags))).alias("x")).select("x.*")


def channel_overlap(labelled: DataFrame, flags: list[str]) -> DataFrame:
    """``(channel, other, links)`` of true links that two channels share, from one pass."""
    sums = labelled.where("label = 1").agg(*(F.sum(F.col(a) * F.col(b)).alias(f"{a}|{b}") for i, a in enumerate(flags) for b in flags[i + 1 :]))
    cells = [F.struct(F.lit(c.split("|")[0]).alias("channel"), F.lit(c.split("|")[1]).alias("other"), F.coalesce(F.col(f"`{c}`"), F.lit(0)).cast("long").alias("links")) for c in sums.columns]
    return sums.select(F.explode(F.array(*cells)).alias("x")).select("x.*")


def threshold_sweep(ids: DataFrame, truth: DataFrame, scored: DataFrame, score: str, thresholds: list[float], key: str | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """Macro F0.5 and micro precision at every threshold, without a row for each entity or pair and threshold.

    An entity's F0.5 changes only at the highest threshold that one of its pairs reaches; the changes are summed a threshold,
    and running sums of those few rows from the top are the averages. ``key`` is a column of ``scored`` whose values are swept apart, ``by``
    are columns of ``ids`` whose groups are averaged apart.
    """
    grid = sorted(thresholds)
    table = F.split(F.lit(",".join(map(repr, map(float, grid)))), ",").cast("array<double>")
    keys = [key] if key else []
    links = truth.select(*PAIR).distinct()
    # the score is bound to a variable first, so that it isn't worked out once for every threshold
    steps = F.transform(F.array(score), lambda x: F.size(F.filter(table, lambda t: t <= x)))[0]
    hit = scored.select(*PAIR, *keys, steps.alias("step")).where("step > 0").join(links.withColumn("label", F.lit(1)), PAIR, "left")
    found = hit.groupBy(PAIR[0], *keys, "step").agg(F.count(F.lit(1)).alias("n"), F.count("label").alias("tp"))
    sized = ids.select(PAIR[0], *by).join(links.groupBy(PAIR[0]).agg(F.count(F.lit(1)).alias("n_true")), PAIR[0], "left").fillna(0, ["n_true"])
    down = f"over (partition by {', '.join([PAIR[0], *keys])} order by step desc)"
    rows = found.join(sized, PAIR[0]).withColumns({"sum_n": F.expr(f"sum(n) {down}"), "sum_tp": F.expr(f"sum(tp) {down}")})
    rows = rows.withColumn("f", f05(F.col("sum_tp"), F.col("sum_n"), F.col("n_true"))).withColumn("gain", F.col("f") - F.expr(f"coalesce(lag(f) {down}, if(n_true = 0, 1d, 0d))"))
    per = rows.groupBy(*keys, *by, "step").agg(F.sum("gain").alias("gain"), F.sum("n").alias("n"), F.sum("tp").alias("tp"))
    base = sized.groupBy(*by).agg(F.count(F.lit(1)).alias("entities"), F.sum((F.col("n_true") == 0).cast("double")).alias("base"))
    cells = base.select("*", F.posexplode(table).alias("step", "threshold")).withColumn("step", F.col("step") + 1)
    if key:
        values = scored.select(F.array_sort(F.collect_set(key)).alias("values")).first()[0]  # one row a value that is swept
        cells = cells.withColumn(key, F.explode(F.lit(values).cast(f"array<{scored.schema[key].dataType.simpleString()}>")))
    cells = cells.join(per, [*keys, *by, "step"], "left").fillna(0, ["gain", "n", "tp"])
    all_down = f"over (partition by {', '.join([*keys, *by]) or 'base'} order by step desc)"
    sums = cells.withColumns({c: F.expr(f"sum({c}) {all_down}") for c in ("gain", "n", "tp")})
    return sums.select(*keys, *by, "threshold", F.round((F.col("base") + F.col("gain")) / F.col("entities"), 12).alias("macro_f05"), F.when(F.col("n") == 0, 0.0).otherwise(F.col("tp") / F.col("n")).alias("micro_precision"))


def best_threshold(sweep: DataFrame, first: bool = False, by: tuple[str, ...] = ()) -> DataFrame:
    """The best F0.5, ties by micro precision and then the larger threshold; ``first`` takes the smallest of the best instead. One row, or one a group."""
    order = "macro_f05 desc, threshold" if first else "macro_f05 desc, micro_precision desc, threshold desc"
    groups = f"partition by {', '.join(by)} " if by else ""
    return sweep.withColumn("_place", F.expr(f"row_number() over ({groups}order by {order})")).where("_place = 1").drop("_place")


def decode(scored: DataFrame, score: str, threshold: float, by_country: dict[str, float] | None = None, country: str = "country") -> DataFrame:
    """Pairs at or above the threshold; a country in ``by_country`` has its own."""
    limit = F.lit(threshold)
    for name, value in (by_country or {}).items():
        limit = F.when(F.col(country) == name, value).otherwise(limit)
    return scored.where(F.col(score) >= limit)


def blend_sweep(ids: DataFrame, truth: DataFrame, scored: DataFrame, a: str, b: str, alphas: list[float], thresholds: list[float], by: tuple[str, ...] = ()) -> DataFrame:
    """``threshold_sweep`` of each blend alpha*a + (1-alpha)*b, all in one job; overall or by columns of ``ids``."""
    blends = scored.select(*PAIR, a, b, F.explode(F.array(*(F.lit(float(x)) for x in alphas))).alias("alpha"))
    return threshold_sweep(ids, truth, blends.withColumn("_blend", F.round(F.col(a) * F.col("alpha") + F.col(b) * (1 - F.col("alpha")), 9)), "_blend", thresholds, "alpha", by)


def disagreement(scored: DataFrame, a: Column, b: Column) -> DataFrame:
    kind = F.when(a & b, "both").when(a, "only_a").when(b, "only_b").otherwise("neither")
    return scored.groupBy(kind.alias("decision")).agg(F.count(F.lit(1)).alias("pairs"), F.sum("label").cast("long").alias("true_pairs"))


def false_negatives(truth: DataFrame, candidates: DataFrame, predicted: DataFrame, source: DataFrame) -> DataFrame:
    """True links by country: found, missed by retrieval, rejected by the classifier."""
    c, p = candidates.select(*PAIR).distinct().withColumn("c", F.lit(1)), predicted.select(*PAIR).distinct().withColumn("p", F.lit(1))
    kind = F.when(F.col("p") == 1, "found").when(F.col("c") == 1, "rejected").otherwise("not_retrieved")
    rows = truth.join(c, PAIR, "left").join(p, PAIR, "left").join(source.select(F.col("entity_id").alias(PAIR[0]), F.col("country_norm").alias("country")), PAIR[0])
    return rows.groupBy("country", kind.alias("outcome")).agg(F.count(F.lit(1)).alias("links"))


def first_of(branches: list[tuple[str, Column]], other: str) -> Column:
    """The name of the first condition that holds."""
    out = F.lit(other)
    for name, condition in reversed(branches):
        out = F.when(condition, name).otherwise(out)
    return out


def false_positive_pattern() -> Column:
    """Kind of a false positive; the branches are fixed values."""
    c = F.col
    return F.when((c("name_full_exact") == 1) & (c("address_exact") == 0), "exact name, different address").when(c("numeric_token_conflict") == 1, "address-number conflict").when((c("address_exact") == 1) & (c("name_core_exact") == 0), "exact address, different name").otherwise("other similarity collision")


def retrieval_failure() -> Column:
    """Why a true link wasn't retrieved, from ``charsim, address_jaccard, l_core, r_core, raw``; the first that holds. The limits are fixed values."""
    from linkforge.functions.text import script_mismatch

    c, shortest = F.col, F.least(F.length("l_core"), F.length("r_core"))
    ratio = shortest / F.greatest(F.length("l_core"), F.length("r_core"), F.lit(1))
    marked = c("raw").rlike(r"\.com| dba |d/b/a|trading as| aka ")
    short = "abbreviation/domain/trade-name"
    return F.when(script_mismatch(c("l_core"), c("r_core")), "transliteration/script mismatch").when((c("charsim") < 0.35) & (c("address_jaccard") >= 0.35), "address-only evidence").when(marked, short).when((ratio < 0.60) & (c("charsim") >= 0.30), short).when(shortest <= 5, "generic/short name").when(c("charsim") < 0.55, "severe spelling corruption").otherwise("other")


def _by_score(scored: DataFrame, score: str, label: str) -> DataFrame:
    """A row for each distinct score from the highest down: positives and rows of the score, and running sums of both.

    Scores lie in [0, 1]. Running sums are taken within 1,024 ranges of scores, and over the ranges' totals, so no task orders all of them.
    """
    per = scored.groupBy(F.col(score).alias("score")).agg(F.sum(label).alias("tp"), F.count(F.lit(1)).alias("n")).withColumn("part", F.floor(F.col("score") * 1024))
    totals = per.groupBy("part").agg(F.sum("tp").alias("part_tp"), F.sum("n").alias("part_n"))
    before = totals.select("part", *(F.expr(f"sum({c}) over (order by part desc) - {c}").alias(f"before_{c[5:]}") for c in ("part_tp", "part_n")))
    run = per.join(before, "part")
    return run.withColumns({f"{c}s": F.expr(f"before_{c} + sum({c}) over (partition by part order by score desc)") for c in ("tp", "n")})


def average_precision(scored: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """Sum of precision times the step in recall over the distinct scores, from the highest down."""
    return _by_score(scored, score, label).agg((F.sum(F.col("tp") / F.lit(1) * F.col("tps") / F.col("ns")) / F.sum("tp")).alias("average_precision"))


def probability_metrics(scored: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """One row: ``roc_auc, average_precision, log_loss``. Pairs of equal scores count half in the first; probabilities are clipped to 1e-15 in the last."""
    rows = _by_score(scored, score, label)
    negative, above = F.col("n") - F.col("tp"), F.col("tps") - F.col("tp")
    p = F.greatest(F.least(F.col("score"), F.lit(1 - 1e-15)), F.lit(1e-15))
    loss = -(F.col("tp") * F.log(p) + negative * F.log(1 - p))
    pairs = F.sum("tp").cast("double") * F.sum(negative)
    return rows.agg((F.sum(negative * (above + 0.5 * F.col("tp"))) / pairs).alias("roc_auc"), (F.sum(F.col("tp") / F.lit(1) * F.col("tps") / F.col("ns")) / F.sum("tp")).alias("average_precision"), (F.sum(loss) / F.sum("n")).alias("log_loss"))


def distribution(frame: DataFrame, value: str, *by: str) -> DataFrame:
    """Count, minimum, 5th percentile, quartiles, 95th percentile and maximum."""
    q = lambda p: F.percentile(F.col(value), F.lit(p))
    return frame.groupBy(*by).agg(F.count(value).alias("n"), F.min(value).alias("minimum"), q(0.05).alias("p05"), q(0.25).alias("p25"), q(0.5).alias("median"), q(0.75).alias("p75"), q(0.95).alias("p95"), F.max(value).alias("maximum"))
