"""Result frames and their validation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkforge.sources.records import DataValidationError, write_tsv

PAIR = ["source1_entity_id", "candidate_entity_id"]


def result_frame(ids: DataFrame, pairs: DataFrame, rank: str, column: str) -> DataFrame:
    """One row a source record, its candidates by (rank, id) as a comma list; none gives an empty string."""
    lists = pairs.groupBy(PAIR[0]).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(rank, PAIR[1]))), lambda x: x[PAIR[1]]), ",").alias(column))
    return ids.join(lists, PAIR[0], "left").fillna("", [column]).select(PAIR[0], column)


def violations(ids: DataFrame, feed_ids: DataFrame, matched: DataFrame, candidates: DataFrame) -> DataFrame:
    """``(problem, rows)`` of result frames: repeated or missing source rows, repeated, unknown or wrongly prefixed ids, matches that aren't candidates."""
    split = lambda df, c: df.select(PAIR[0], F.posexplode(F.filter(F.split(c, ","), lambda x: x != "")).alias("pos", PAIR[1]))
    m, c = split(matched, "matched_entity_ids"), split(candidates, "candidate_entity_ids")
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("problem"), "rows")
    known = feed_ids.select(F.col("entity_id").alias(PAIR[1]))
    out = [count(matched.groupBy(PAIR[0]).count().where("count > 1"), "duplicate_source"), count(ids.join(matched, PAIR[0], "left_anti"), "missing_source"), count(matched.join(ids, PAIR[0], "left_anti"), "unknown_source")]
    out += [count(m.groupBy(*PAIR).count().where("count > 1"), "duplicate_match"), count(m.where(~F.col(PAIR[1]).rlike("^S[23]-")), "wrong_prefix"), count(m.join(known, PAIR[1], "left_anti"), "unknown_match"), count(m.join(c, PAIR, "left_anti"), "match_not_candidate")]
    total = out[0]
    for x in out[1:]:
        total = total.unionByName(x)
    return total


def result_frames(ids: DataFrame, candidates: DataFrame, predicted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(matching, candidate) result frames: every candidate, and the predicted ones of them, both in candidate order."""
    kept = candidates.join(predicted.select(*PAIR).distinct(), PAIR, "left_semi")
    return result_frame(ids, kept, "cheap_rank", "matched_entity_ids"), result_frame(ids, candidates, "cheap_rank", "candidate_entity_ids")


def write_submission(ids: DataFrame, feed_ids: DataFrame, matched: DataFrame, candidates: DataFrame, folder: str) -> tuple[str, str]:
    """Check both result frames, and write them as matching_results.tsv and candidate_pairs.tsv; refuses to overwrite."""
    for frame, column in ((matched, "matched_entity_ids"), (candidates, "candidate_entity_ids")):
        if frame.columns != [PAIR[0], column]:
            raise DataValidationError(f"expected columns {[PAIR[0], column]}, found {frame.columns}")
    if bad := {r.problem: r.rows for r in violations(ids, feed_ids, matched, candidates).collect() if r.rows}:
        raise DataValidationError(f"results break their contract: {bad}")
    paths = f"{folder}/matching_results.tsv", f"{folder}/candidate_pairs.tsv"
    write_tsv(matched, paths[0])
    write_tsv(candidates, paths[1])
    return paths
