"""Shared folder, staged tables, connected components and Arrow helpers."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the cluster names it.

    Only where ``spark.checkpoint.dir`` is unset in local mode (tests) is one made; on a cluster
    that is an error, as executors don't see the driver's folders.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        own = spark.sparkContext._jsc.sc().getCheckpointDir()
        if own.isEmpty():
            if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="linkforge-"))
            own = spark.sparkContext._jsc.sc().getCheckpointDir()
        named = own.get()
    return named.rstrip("/")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: cuts the lineage and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete the folders of ``staged`` tables that nothing reads any more."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table._staged_at)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def local_rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """Rows of the driver as a frame, handed over in Arrow: those of a plain list would pass through Python workers of their own in the executors."""
    if not rows:
        return spark.createDataFrame([], schema)
    kinds = to_arrow_schema(StructType.fromDDL(schema))
    return spark.createDataFrame(pa.table([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(kinds)], schema=kinds))


def n_words(text) -> F.Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` runs; null text has none."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"))


def column_of(batch: pa.RecordBatch, path: str) -> pa.Array:
    """A column, or a field of a struct column as ``column.field``."""
    name, _, field = path.partition(".")
    return pc.struct_field(batch.column(name), field) if field else batch.column(name)


def text_slices(batches: Iterator[pa.RecordBatch], column: str, most: int) -> Iterator[pa.RecordBatch]:
    """Zero-copy slices of the batches holding about ``most`` bytes of ``column`` (see ``column_of``) each, one row at least."""
    for batch in batches:
        sizes = pc.binary_length(column_of(batch, column).cast(pa.large_binary())).fill_null(0).to_numpy(zero_copy_only=False)
        start = held = 0
        for i, n in enumerate(sizes):
            if held and held + n > most:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += int(n) + 1
        if start < batch.num_rows:
            yield batch.slice(start)


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Root (smallest reachable id) of every node of ``edges``: ``(node, root)``, alternating large- and small-star.

    All steps are joins and aggregations on the edge list; each round is staged in the
    shared folder, and the one before deleted; the result may be discarded like a staged table. Self-loops are dropped, so isolated nodes are not returned.
    """
    now = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()

    def stamp(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    now = staged(now, "edges")
    mark = stamp(now)
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")))).alias("e"))
        after = staged(small.select("e.u", "e.v").where("u <> v").distinct(), "edges")
        was, mark = mark, stamp(after)
        discard(now)
        now = after
        if mark == was:
            out = now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
            out._staged_at = now._staged_at
            return out
