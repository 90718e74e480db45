"""Command line: ``python -m linkforge.cli --stage NAME --source1 S1.tsv --feed S2.tsv S3.tsv --truth T.tsv --out FOLDER``.

``audit`` tells columns, rows and sizes of the inputs; ``evaluate`` writes artifacts and a report; ``submit`` writes the two result files of
all source records, and wants --confirm; ``validate`` checks result files that exist; the others print one JSON line a variant.
"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from linkforge.config import LinkConfig
from linkforge.operators import submission
from linkforge.plans import stages
from linkforge.sources import records


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("--stage", choices=sorted([*stages.STAGES, "audit", "evaluate", "submit", "validate"]), required=True)
    parser.add_argument("--source1", required=True)
    parser.add_argument("--feed", nargs="+", required=True)
    parser.add_argument("--truth")
    parser.add_argument("--out")
    parser.add_argument("--confirm", action="store_true")
    parser.add_argument("--candidate-k", type=int, default=30)
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("linkforge").getOrCreate()
    if args.stage == "audit":
        for path in (args.source1, *args.feed):
            records.event("audit", path=path, **records.inspect_tsv(spark, path), rows=records.count_tsv_rows(spark, path))
        return 0
    parts = [records.load_source(spark, path, f"S{i}") for i, path in enumerate([args.source1, *args.feed], 1)]
    config = LinkConfig(candidate_k=args.candidate_k)
    if args.stage == "validate":
        return validate(spark, parts, args.out)
    source, *feeds = (records.staged(records.normalize_records(part)) for part in parts)
    feed = feeds[0]
    for part in feeds[1:]:
        feed = feed.unionByName(part)
    if args.stage == "submit":
        if not args.confirm:
            raise SystemExit("all source records are only linked with --confirm")
        records.event("submitted", paths=stages.submit(source, feed, config, args.out))
        return 0
    truth = records.staged(records.explode_truth(records.load_truth(spark, args.truth)))
    if args.stage == "evaluate":
        stages.evaluate(source, feed, truth, config, args.out)
        return 0
    for row in stages.STAGES[args.stage](source, feed, truth, config).collect():
        print(json.dumps(row.asDict(), sort_keys=True))
    return 0


def validate(spark: SparkSession, parts: list, folder: str) -> int:
    """Checks the result files under ``folder`` against the inputs; 0 if they keep their contract."""
    pair = submission.PAIR[0]
    matched = records.read_tsv(spark, f"{folder}/matching_results.tsv", [pair, "matched_entity_ids"])
    listed = records.read_tsv(spark, f"{folder}/candidate_pairs.tsv", [pair, "candidate_entity_ids"])
    feed = parts[1].select("entity_id")
    for part in parts[2:]:
        feed = feed.unionByName(part.select("entity_id"))
    found = submission.violations(parts[0].select(F.col("entity_id").alias(pair)), feed, matched, listed).collect()
    for r in found:
        records.event("checked", problem=r.problem, rows=r.rows)
    return int(any(r.rows for r in found))


if __name__ == "__main__":
    raise SystemExit(main())
