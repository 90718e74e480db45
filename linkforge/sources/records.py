"""Scans, sinks and validation of source records, truth lists and results."""

from __future__ import annotations

import json
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from linkforge.functions import text as T

SOURCE_COLUMNS = ["entity_id", "business_name", "business_address", "country"]
TRUTH_COLUMNS = ["source1_entity_id", "matched_entity_ids"]


class DataValidationError(ValueError):
    """Input or output breaks its contract."""


def read_tsv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A tab-separated file with a header, all strings, empty fields as empty strings; the header must equal ``columns``."""
    options = {"sep": "\t", "header": True, "quote": '"', "escape": '"', "multiLine": True, "encoding": "utf-8"}
    found = spark.read.options(**options).csv(path).columns
    check_columns(found, columns)
    schema = StructType([StructField(c, StringType()) for c in columns])
    return spark.read.options(**options).schema(schema).csv(path).fillna("", columns)


def check_columns(found: list[str], expected: list[str]) -> None:
    if list(found) != list(expected):
        raise DataValidationError(f"expected columns {expected}, found {found}")


def source_violations(records: DataFrame, prefix: str) -> DataFrame:
    """``(problem, rows)``: empty ids, wrong prefixes and repeated ids, in one pass over the ids."""
    per_id = records.groupBy("entity_id").count()
    out = per_id.agg(F.sum(F.when(F.col("entity_id") == "", F.col("count"))).alias("empty_id"), F.sum(F.when(~F.col("entity_id").startswith(prefix), F.col("count"))).alias("wrong_prefix"), F.sum(F.when(F.col("count") > 1, F.lit(1))).alias("duplicate_id"))
    return out.select(F.explode(F.array(*(F.struct(F.lit(c).alias("problem"), F.coalesce(F.col(c), F.lit(0)).cast("long").alias("rows")) for c in out.columns))).alias("x")).select("x.*")


def load_source(spark: SparkSession, path: str, source: str, validate: bool = True) -> DataFrame:
    records = read_tsv(spark, path, SOURCE_COLUMNS)
    if validate and (bad := [f"{r.problem}: {r.rows}" for r in source_violations(records, f"{source}-").collect() if r.rows]):
        raise DataValidationError("; ".join(bad))
    return records


def load_truth(spark: SparkSession, path: str, validate: bool = True) -> DataFrame:
    truth = read_tsv(spark, path, TRUTH_COLUMNS)
    if validate:
        ids = F.filter(F.split("matched_entity_ids", ","), lambda x: x != "")
        bad = truth.select("source1_entity_id", (F.size(ids) != F.size(F.array_distinct(ids))).alias("twice"), F.exists(ids, lambda x: ~x.rlike("^S[23]-")).alias("target"))
        bad = bad.groupBy("source1_entity_id").agg(F.count(F.lit(1)).alias("n"), F.max("twice").alias("twice"), F.max("target").alias("target"))
        if not bad.where((F.col("n") > 1) | F.col("twice") | F.col("target") | ~F.col("source1_entity_id").startswith("S1-")).isEmpty():
            raise DataValidationError("truth rows repeat, or hold repeated ids or ids of another source")
    return truth


def explode_truth(truth: DataFrame) -> DataFrame:
    """``(source1_entity_id, candidate_entity_id)``, one row a link; empty lists give none."""
    ids = F.transform(F.split("matched_entity_ids", ","), lambda x: F.trim(x))
    return truth.select("source1_entity_id", F.explode(F.filter(ids, lambda x: x != "")).alias("candidate_entity_id")).distinct()


def inspect_tsv(spark: SparkSession, path: str) -> dict:
    head = spark.read.options(sep="\t", header=True).csv(path).limit(5)
    size = spark.read.format("binaryFile").load(path).select(F.sum("length")).first()[0]
    return {"columns": head.columns, "sample_rows": head.count(), "bytes": size}


def count_tsv_rows(spark: SparkSession, path: str) -> int:
    return max(0, spark.read.text(path).count() - 1)


def write_tsv(frame: DataFrame, path: str) -> None:
    """Refuses to overwrite; empty strings stay unquoted."""
    frame.write.mode("errorifexists").options(sep="\t", header=True, emptyValue="").csv(path)


def write_cache(frame: DataFrame, path: str, metadata: dict) -> None:
    """Parquet and a JSON sidecar of what it was made with."""
    frame.write.mode("errorifexists").parquet(path)
    frame.sparkSession.createDataFrame([(json.dumps(metadata, sort_keys=True),)], "value string").coalesce(1).write.text(f"{path}.meta")


def read_cache(spark: SparkSession, path: str, fingerprint: str | None = None) -> DataFrame:
    found = json.loads(spark.read.text(f"{path}.meta").first()[0])
    if fingerprint is not None and found.get("fingerprint") != fingerprint:
        raise DataValidationError(f"cache was made with {found.get('fingerprint')}")
    return spark.read.parquet(path)


def staged(frame: DataFrame) -> DataFrame:
    """Write a frame to the folder that driver and executors share and read it again: it is made once, and survives lost executors.

    The folder is that of ``spark.checkpoint.dir``; only in local mode one is made where that is unset.
    """
    spark = frame.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        own = spark.sparkContext._jsc.sc().getCheckpointDir()
        if own.isEmpty():
            if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="linkforge-"))
            own = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = own.get()
    path = f"{folder.rstrip('/')}/frame-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def latest(spark: SparkSession, pattern: str) -> str:
    """The path that matches ``pattern`` and was changed last; an error if none does."""
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    if not found:
        raise FileNotFoundError(pattern)
    return max(((f.getModificationTime(), f.getPath().toString()) for f in found))[1]


def check_records(records: DataFrame, prefixes: tuple[str, ...]) -> None:
    """Raises unless the columns that operators read are there and every id has one of the prefixes."""
    if missing := [c for c in ("entity_id", "name_full", "address_full", "country_norm") if c not in records.columns]:
        raise DataValidationError(f"missing columns {missing}")
    known = F.lit(False)
    for prefix in prefixes:
        known = known | F.col("entity_id").startswith(prefix)
    if bad := [r.entity_id for r in records.where(~F.coalesce(known, F.lit(False))).select("entity_id").limit(5).collect()]:
        raise DataValidationError(f"ids without a prefix of {prefixes}: {bad}")


def check_unique(frame: DataFrame, *keys: str) -> None:
    """Raises if some rows agree in the keys, as a one-to-one or many-to-one join needs them not to."""
    if bad := [tuple(r)[:-1] for r in frame.groupBy(*keys).count().where("count > 1").limit(5).collect()]:
        raise DataValidationError(f"repeated {keys}: {bad}")


def write_artifacts(frames: dict[str, DataFrame], folder: str, metadata: dict) -> None:
    """Each frame as a cache of its own under ``folder``; refuses to overwrite any."""
    for name, frame in frames.items():
        write_cache(frame, f"{folder}/{name}", {**metadata, "artifact": name})


def write_report(spark: SparkSession, report: dict, path: str) -> None:
    """A JSON report with sorted keys, as one text file; refuses to overwrite."""
    spark.createDataFrame([(json.dumps(report, sort_keys=True, default=float),)], "value string").coalesce(1).write.mode("errorifexists").text(path)


def event(name: str, **details) -> None:
    """One line of the event log on standard output."""
    print(json.dumps({"event": name, **details}, sort_keys=True, default=float), flush=True)


def normalize_records(records: DataFrame) -> DataFrame:
    """Source records with their canonical name, address and country views."""
    out = records.withColumns({"name_raw": F.col("business_name"), "name_full": T.canonical(F.col("business_name"), True), "address_raw": F.col("business_address"), "address_full": T.canonical(F.col("business_address")), "country_norm": T.fold_country(F.coalesce("country", F.lit("")))})
    out = out.withColumns({"name_core": T.core_name(F.col("name_full")), "legal_form": T.legal_form(F.col("name_full")), "name_tokens": T.tokens(F.col("name_full")), "address_core": F.col("address_full"), "address_tokens": T.tokens(F.col("address_full")), "address_numeric_tokens": T.numeric_tokens(F.col("address_full")), "postcode": T.postcode(F.col("address_full"))})
    return out.withColumns({"name_sorted": T.sorted_view(F.col("name_core")), "name_acronym": T.acronym(F.col("name_core"))})


def document_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The test adapter: documents as source records of three sides, as FIXTURES.md defines them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    n = F.substring("source", 4, 10).cast("int")
    side = F.when(n < 4, "S1").when(n < 12, "S2").otherwise("S3")
    words = F.split("text", r"\s+")
    suffix = F.element_at(F.array(F.lit(""), F.lit(" Ltd."), F.lit(" Pvt Limited"), F.lit(" & Co"), F.lit(" LLC")), (F.col("doc_id") % 5 + 1).cast("int"))
    address = F.concat(F.array_join(F.slice(words, 7, 8), " "), F.lit(" "), F.col("n_chars").cast("string"), F.lit(" "), F.lpad((F.col("n_chars") * 37 % 100000).cast("string"), 5, "0"))
    return docs.select(F.concat(side, F.lit("-"), F.col("doc_id").cast("string")).alias("entity_id"), F.concat(F.array_join(F.slice(words, 1, 6), " "), suffix).alias("business_name"), F.when(F.col("doc_id") % 17 == 0, "").otherwise(address).alias("business_address"), F.col("lang").alias("country"))


def document_feed(spark: SparkSession, sf_dir: str, copies: int) -> DataFrame:
    """A larger test feed: the S2 and S3 records of ``document_records``, and up to ``copies`` - 1 more of each document, with the name and address from further on in its text."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("words", F.split("text", r"\s+"))
    n = F.substring("source", 4, 10).cast("int")
    rows = docs.where(n >= 4).withColumn("k", F.explode(F.sequence(F.lit(0), F.least(F.lit(copies - 1), F.greatest(F.lit(0), F.floor(F.size("words") / 14).cast("int") - 1)))))
    name, address = F.array_join(F.slice("words", F.col("k") * 14 + 1, 6), " "), F.array_join(F.slice("words", F.col("k") * 14 + 7, 8), " ")
    number = F.lpad(((F.col("n_chars") + F.col("k")) * 37 % 100000).cast("string"), 5, "0")
    return rows.select(F.concat(F.when(n < 12, "S2").otherwise("S3"), F.lit("-"), F.col("doc_id"), F.lit("-"), F.col("k")).alias("entity_id"), name.alias("business_name"), F.concat_ws(" ", address, F.col("n_chars"), number).alias("business_address"), F.col("lang").alias("country"))


def document_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of the adapter's S1 to the S2 and S3 records whose documents have equal normalised texts."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    n = F.substring("source", 4, 10).cast("int")
    side = F.when(n < 4, "S1").when(n < 12, "S2").otherwise("S3")
    keyed = docs.select(F.concat(side, F.lit("-"), F.col("doc_id").cast("string")).alias("id"), F.sha2(T.canonical(F.col("text")), 256).alias("k"))
    left, right = keyed.where(F.col("id").startswith("S1-")), keyed.where(~F.col("id").startswith("S1-"))
    return left.select(F.col("id").alias("source1_entity_id"), "k").join(right.select(F.col("id").alias("candidate_entity_id"), "k"), "k").drop("k")
