"""Reading and writing claims, scoring records, SQL results and reports."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from carespend.session import shared_path
from carespend.sources.schema import CLAIMS, INDEX_COLUMN, RECORDS


def typed(c: str, kind: T.DataType) -> Column:
    """A text column as another type. Whole numbers may be written as ``45.0``; what does not parse is null."""
    text = F.col(f"`{c}`")
    if not isinstance(kind, T.IntegralType):
        return text.try_cast(kind)
    value = text.try_cast("double")
    return F.coalesce(text.try_cast(kind), F.when(value == F.floor(value), value.try_cast(kind)))


def from_text(df: DataFrame, schema: T.StructType, bad_fields: str | None = None) -> DataFrame:
    """Text columns as the types of ``schema``; absent ones are null.

    With ``bad_fields``, an array column of that name lists the fields of each row that hold
    text which does not parse, so that a bad value is told apart from an absent one.
    """
    values = {f.name: typed(f.name, f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType) for f in schema.fields}
    out = [v.alias(n) for n, v in values.items()]
    if bad_fields:
        lost = [F.when((F.trim(F.col(f"`{n}`")) != "") & v.isNull(), F.lit(n)) for n, v in values.items() if n in df.columns]
        out.append(F.array_compact(F.array(*lost)).alias(bad_fields))
    return df.select(out)


def read_claims(
    spark: SparkSession,
    path: str,
    fmt: str = "parquet",
    schema: T.StructType | None = CLAIMS,
    bad_fields: str | None = None,
) -> DataFrame:
    """The claims table from files, with a fixed schema so that no pass is spent on inference.

    CSV columns are matched by header name, so the column order in the file and an
    exported index column do not matter; cells that do not parse become null, and are named in
    the column ``bad_fields`` if one is asked for.
    """
    if fmt != "csv":
        reader = spark.read.format(fmt)
        return (reader.schema(schema) if schema is not None else reader).load(path)
    text = spark.read.option("header", True).csv(path).drop(INDEX_COLUMN)
    if schema is None:
        return text
    return from_text(text, schema, bad_fields)


def read_table(spark: SparkSession, name: str, **jdbc: str) -> DataFrame:
    """A catalog table, or a database table when JDBC options are given.

    Pass ``partitionColumn``, ``lowerBound``, ``upperBound`` and ``numPartitions`` to
    read a large database table in parallel.
    """
    if not jdbc:
        return spark.table(name)
    split = {"partitionColumn", "lowerBound", "upperBound", "numPartitions"}
    if split & jdbc.keys() and not split <= jdbc.keys():
        raise ValueError(f"parallel reads need all of {sorted(split)}")
    return spark.read.format("jdbc").option("dbtable", name).options(**jdbc).load()


def run_sql(views: dict[str, DataFrame], text: str) -> DataFrame:
    """Run SQL text in which ``{name}`` stands for one of the given frames."""
    spark = next(iter(views.values())).sparkSession
    return spark.sql(text, **views)


def write_claims(
    df: DataFrame,
    path: str | None = None,
    table: str | None = None,
    bucket_by: str | None = None,
    buckets: int = 0,
) -> None:
    """Replace the claims table, partitioned by year.

    With ``table``, ``bucket_by="member_id"`` also buckets the files, so per-member
    windows and joins on the member read them without another shuffle.
    """
    out = df if "year" in df.columns else df.withColumn("year", F.year("month"))
    if bucket_by and not (table and buckets > 0):
        raise ValueError("bucketing needs a table name and a bucket count")
    # Rebalancing gathers each year (and bucket) into few files, and adaptive execution
    # splits a year or bucket that is too large for one task.
    if bucket_by:
        bucket = F.pmod(F.hash(bucket_by), F.lit(buckets))
        out = out.withColumn("_bucket", bucket).hint("rebalance", "year", "_bucket").drop("_bucket")
    else:
        out = out.hint("rebalance", "year")
    writer = out.write.mode("overwrite").partitionBy("year")
    if table is None:
        writer.parquet(path)
        return
    if bucket_by:
        writer = writer.bucketBy(buckets, bucket_by).sortBy(bucket_by, "month")
    if path:
        writer = writer.option("path", path)
    writer.format("parquet").saveAsTable(table)


def _files(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark._jsc.hadoopConfiguration())


def versions(spark: SparkSession, path: str) -> list[str]:
    """The complete versions of a table below ``path``, oldest first. A version whose write did not end is not among them."""
    folder, files = _files(spark, path)
    if not files.exists(folder):
        return []
    names = sorted(s.getPath().getName() for s in files.listStatus(folder) if s.getPath().getName().startswith("version-"))
    return [n for n in names if files.exists(spark._jvm.org.apache.hadoop.fs.Path(folder, f"{n}/_SUCCESS"))]


def replace_table(df: DataFrame, name: str, path: str, partition_by: Iterable[str] = ()) -> DataFrame:
    """Replace the rows of the table ``name``, or make it, and return the new table.

    The rows are written beside the old ones, as a version of their own below ``path``; then
    the name, a view over one version, is pointed at them in a single catalog call. A write
    that fails leaves the old table as it was, readers that have begun keep their files, and
    a table can be replaced by what is computed from itself. ``drop_versions`` deletes old files.
    """
    spark = df.sparkSession
    version = f"{path}/version-{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
    columns = list(partition_by)
    writer = df.hint("rebalance", *columns).write if columns else df.write
    (writer.partitionBy(*columns) if columns else writer).parquet(version)
    stored = spark.read.schema(df.schema).parquet(version).select(df.columns)
    if columns and stored.isEmpty():  # a partitioned write without rows leaves no file to tell the columns
        stored.coalesce(1).write.mode("append").parquet(version)
    fields = ", ".join(f"CAST(`{f.name}` AS {f.dataType.simpleString()}) AS `{f.name}`" for f in df.schema.fields)
    spark.sql(f"CREATE OR REPLACE VIEW {name} AS SELECT {fields} FROM parquet.`{version}`")
    return stored


def drop_versions(spark: SparkSession, path: str, keep: int = 1) -> list[str]:
    """Delete all but the newest ``keep`` complete versions, and what failed writes have left before them. Call it when no reader needs them."""
    folder, files = _files(spark, path)
    kept = versions(spark, path)[-max(1, keep) :]
    gone = []
    for s in files.listStatus(folder) if kept else []:
        name = s.getPath().getName()
        if name.startswith("version-") and name < kept[0]:
            files.delete(s.getPath(), True)
            gone.append(name)
    return sorted(gone)


def read_records(spark: SparkSession, path: str, bad_fields: str | None = None) -> DataFrame:
    """Scoring records from JSON lines; fields a record leaves out are null.

    Numbers may come as numbers or as text, whole ones also as ``72.0``. What does not parse is
    null, and is named in the column ``bad_fields`` if one is asked for.
    """
    text = T.StructType([T.StructField(f.name, T.StringType()) for f in RECORDS.fields])
    return from_text(spark.read.schema(text).json(path), RECORDS, bad_fields)


def write_report(df: DataFrame, path: str) -> None:
    """Write a report as CSV with a header, replacing what is there."""
    df.write.mode("overwrite").option("header", True).csv(path)


def as_series(df: DataFrame, key: str, *values: str) -> DataFrame:
    """One row of parallel arrays sorted by ``key``. For grouped results: the arrays hold every row."""
    points = F.sort_array(F.collect_list(F.struct(key, *values)))
    return df.agg(points.alias("p")).select([F.col("p")[c].alias(c) for c in (key, *values)])


def read_meta(spark: SparkSession, path: str) -> dict:
    """A small JSON document written by ``write_meta``."""
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def write_meta(spark: SparkSession, path: str, meta: dict) -> None:
    spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write a frame to the shared folder and read it back.

    For frames that are read many times: later reads are pruned scans with known sizes, and
    nothing has to be computed again if an executor is lost.
    """
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def unstage(df: DataFrame) -> None:
    """Delete what ``stage`` wrote for this frame, which no one reads any more."""
    folder, files = _files(df.sparkSession, df._staged_at)
    files.delete(folder, True)


def spread(df: DataFrame) -> DataFrame:
    """At least one partition per core, for files that hold too few row groups to keep all cores busy.

    For stored frames only, as counting the partitions of anything else would compute it. A
    table of many files has enough partitions and is not shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)
