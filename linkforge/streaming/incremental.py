"""Linking feed records as they arrive against a fixed source side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from linkforge.config import LinkConfig
from linkforge.operators.blocking import generate_candidates
from linkforge.sources.records import normalize_records


def link_stream(arriving: DataFrame, source: DataFrame, out: str, checkpoint: str, config: LinkConfig) -> StreamingQuery:
    """Write each micro-batch's candidates to its own folder under ``out``, so a batch that is run again replaces itself."""

    def batch(feed: DataFrame, number: int) -> None:
        generate_candidates(source, normalize_records(feed), config).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return arriving.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
