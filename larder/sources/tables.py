"""Tables: layers, writes, tags, statistics, compaction and views."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator, Mapping
from contextlib import contextmanager
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larder.params import LAYERS

_STEPS: dict[str, list[str]] = {}  # by application: the folders materialize() has written
_RELEASES: dict[str, int] = {}  # by application: how often release() has removed any


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the folder the cluster shares between its machines.

    That is ``spark.checkpoint.dir``; where it is unset, a folder in the warehouse, which has to
    be shared anyway for tables to work.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        root = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_steps"
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str = "step") -> DataFrame:
    """Write a result to the shared folder and read it back.

    For results that are read several times: the files outlive the executors that wrote them.
    They stay until :func:`release`.
    """
    spark = df.sparkSession
    path = shared_folder(spark, name)
    df.write.parquet(path)
    _STEPS.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.schema(df.schema).parquet(path)


def steps(spark: SparkSession) -> int:
    """How many steps this application has written and not released."""
    return len(_STEPS.get(spark.sparkContext.applicationId, []))


def releases(spark: SparkSession) -> int:
    """How often steps have been released: what was kept before may read files that are gone."""
    return _RELEASES.get(spark.sparkContext.applicationId, 0)


def release(spark: SparkSession, keep: int = 0) -> int:
    """Remove the files of all steps but the first ``keep``; returns how many there were.

    Call it when the results that read them have been saved. A job that others may have steps
    beside keeps those there were when it began.
    """
    written = _STEPS.get(spark.sparkContext.applicationId, [])
    steps, written[keep:] = written[keep:], []
    if steps:
        application = spark.sparkContext.applicationId
        _RELEASES[application] = _RELEASES.get(application, 0) + 1
    jvm = spark.sparkContext._jvm
    for step in steps:
        path = jvm.org.apache.hadoop.fs.Path(step)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return len(steps)


def quoted(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def ensure_layers(spark: SparkSession, layers: Mapping[str, str] = LAYERS) -> DataFrame:
    """Create one schema per layer and list the schemas."""
    for name, text in layers.items():
        spark.sql(f"CREATE SCHEMA IF NOT EXISTS {name} COMMENT {quoted(text)}")
    return spark.sql("SHOW SCHEMAS")


def write_table(
    df: DataFrame,
    name: str,
    mode: str = "overwrite",
    fmt: str = "parquet",
    path: str | None = None,
    partition_by: list[str] | None = None,
    bucket_by: tuple[int, list[str]] | None = None,
    sort_by: list[str] | None = None,
) -> DataFrame:
    """Save a table and return it read back.

    ``overwrite`` replaces data and schema. ``append`` adds rows by column position, so the
    column names are checked against the existing table first. ``bucket_by`` is a number of
    buckets and their columns: later joins, groupings and windows by those columns then need no
    shuffle. Pass data already partitioned alike, or every task writes a file per bucket.
    """
    spark = df.sparkSession
    if mode == "append" and spark.catalog.tableExists(name):
        columns = spark.table(name).columns
        if set(columns) != set(df.columns):
            raise ValueError(f"{name} has columns {columns}, not {df.columns}")
        df = df.select(*columns)
    if mode == "append" and path is not None and not partition_by and not bucket_by:
        # Earlier rows may lie under the path although this session's catalog is new.
        df.write.format(fmt).mode("append").save(path)
        if not spark.catalog.tableExists(name):
            spark.catalog.createTable(name, path=path, source=fmt)
        spark.catalog.refreshTable(name)
        return spark.table(name)
    writer = df.write.format(fmt).mode(mode)
    if path is not None:
        writer = writer.option("path", path)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if bucket_by:
        buckets, columns = bucket_by
        writer = writer.bucketBy(buckets, *columns)
        if sort_by:
            writer = writer.sortBy(*sort_by)
    writer.saveAsTable(name)
    return spark.table(name)


def append_batch(
    df: DataFrame,
    name: str,
    batch: str,
    mode: str = "append",
    fmt: str = "parquet",
    path: str | None = None,
) -> DataFrame:
    """Add the rows of one or more batches to a table that keeps each batch in a folder of its own.

    ``batch`` is the column that tells them apart. A batch that is there already, whole or in part
    from an earlier try, is replaced when the write commits, so that a job can be retried without
    doubling rows; other batches are not read or touched. A try that fails leaves the table as it
    was. A batch has to be written as a whole, and one that turns out empty replaces nothing.
    ``mode="overwrite"`` drops all other batches and the schema. The batch column comes last.
    """
    spark = df.sparkSession
    exists = spark.catalog.tableExists(name)
    if mode == "overwrite" or not exists and path is None:
        return write_table(df, name, "overwrite", fmt, path, partition_by=[batch])
    if exists:
        columns = spark.catalog.listColumns(name)
        if {c.name for c in columns} != set(df.columns):
            raise ValueError(f"{name} has columns {[c.name for c in columns]}, not {df.columns}")
        if [c.name for c in columns if c.isPartition] != [batch]:
            raise ValueError(f"{name} does not keep its batches apart by {batch}")
        path = table_detail(spark, name, "Location").first()["location"]
        df = df.select(*[c.name for c in columns])
    writer = df.write.format(fmt).mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(batch).save(path)
    if not exists:  # earlier batches may lie under the path although this session's catalog is new
        listed = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
        spark.sql(
            f"CREATE TABLE {name} ({listed}) USING {fmt} PARTITIONED BY (`{batch}`) "
            f"LOCATION {quoted(path)}"
        )
    spark.catalog.recoverPartitions(name)
    spark.catalog.refreshTable(name)
    return spark.table(name)


def set_properties(spark: SparkSession, name: str, properties: Mapping[str, str]) -> DataFrame:
    """Tag a table and return all its properties."""
    pairs = ", ".join(f"{quoted(k)} = {quoted(v)}" for k, v in properties.items())
    spark.sql(f"ALTER TABLE {name} SET TBLPROPERTIES ({pairs})")
    return spark.sql(f"SHOW TBLPROPERTIES {name}")


def set_comment(spark: SparkSession, name: str, text: str) -> DataFrame:
    """Describe a table and return the stored description."""
    spark.sql(f"COMMENT ON TABLE {name} IS {quoted(text)}")
    return table_detail(spark, name, "Comment")


def table_detail(spark: SparkSession, name: str, detail: str) -> DataFrame:
    return (
        spark.sql(f"DESCRIBE TABLE EXTENDED {name}")
        .filter(F.col("col_name") == detail)
        .select(F.lit(name).alias("table_name"), F.col("data_type").alias(detail.lower()))
    )


def analyze(spark: SparkSession, name: str, columns: list[str] | str | None = None) -> DataFrame:
    """Collect table statistics, and column statistics for ``columns`` or ``"all"``."""
    scope = ""
    if columns == "all":  # one pass over every column, best kept to narrow tables
        scope = " FOR ALL COLUMNS"
    elif columns:
        scope = " FOR COLUMNS " + ", ".join(columns)
    spark.sql(f"ANALYZE TABLE {name} COMPUTE STATISTICS{scope}")
    numbers = F.col("statistics")
    return table_detail(spark, name, "Statistics").select(
        "table_name",
        F.regexp_extract(numbers, r"(\d+) bytes", 1).cast("bigint").alias("size_in_bytes"),
        F.regexp_extract(numbers, r"(\d+) rows", 1).cast("bigint").alias("row_count"),
    )


def _layout(spark: SparkSession, name: str) -> tuple[list[str], tuple[int, list[str]] | None, list[str]]:
    """Partition columns, buckets as for :func:`write_table`, and the order within files."""
    details = {
        row["col_name"]: row["data_type"]
        for row in spark.sql(f"DESCRIBE TABLE EXTENDED {name}").collect()
    }
    listed = {k: re.findall(r"`([^`]*)`", details.get(f"{k} Columns", "")) for k in ("Bucket", "Sort")}
    partitions = [c.name for c in spark.catalog.listColumns(name) if c.isPartition]
    buckets = (int(details["Num Buckets"]), listed["Bucket"]) if listed["Bucket"] else None
    return partitions, buckets, listed["Sort"]


def file_bins(spark: SparkSession, name: str, target_bytes: int) -> DataFrame:
    """Which files of a table belong together: ``path``, ``size``, and a number ``bin``.

    Within a partition and bucket files are put next to one another by size and cut wherever
    ``target_bytes`` are full, so a bin holds at most that much and one file more. Only the files'
    footers are read. One row per file: a table of files, not of data.
    """
    partitions, buckets, _ = _layout(spark, name)
    # The number of a file's bucket is a part of its name; files of unbucketed tables have none.
    number = F.regexp_extract(F.col("_metadata.file_name"), r"_(\d{5,})(?:\.|$)", 1)
    group = [*partitions, "bucket"]
    found = (
        spark.table(name)
        .select(
            *partitions,
            (number if buckets else F.lit("")).alias("bucket"),
            F.col("_metadata.file_path").alias("path"),
            F.col("_metadata.file_size").alias("size"),
        )
        .groupBy(*group, "path", "size")
        .agg(F.count("*").alias("rows"))
    )
    order = Window.partitionBy(*group).orderBy("size", "path")
    before = F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1))
    place = found.withColumn("part", F.floor(F.coalesce(before, F.lit(0)) / target_bytes))
    every = Window.orderBy(*group, "part")  # of all files, in one task
    return place.select(
        *group,
        "path",
        "size",
        "rows",
        F.count("*").over(Window.partitionBy(*group, "part")).alias("files"),
        (F.dense_rank().over(every) - 1).alias("bin"),
    )


def _partition(folder: str) -> str:
    """A partition's folder, such as a=1/b=x%20y, as SQL names it."""
    pairs = [level.split("=", 1) for level in folder.split("/")]
    return ", ".join(
        f"`{unquote(k)}` = " + ("NULL" if v == "__HIVE_DEFAULT_PARTITION__" else quoted(unquote(v)))
        for k, v in pairs
    )


def compact(
    spark: SparkSession,
    name: str,
    path: str,
    target_file_mb: float = 256,
    fmt: str = "parquet",
) -> DataFrame:
    """Rewrite a table's small files as files of about ``target_file_mb`` under a new ``path``.

    Partitions, buckets and the order within files stay: files are put together within their
    partition and bucket only, a task to each bin of :func:`file_bins`. Rows go to their bin by the
    file they are read from, without a sort or a hash of data. Where no two files would be put
    together nothing is written. The new files are complete before the table is pointed at them, so
    a reader sees the old or the new set, partition by partition, and a failed run leaves the table
    as it was. The old files stay until removed.
    """
    partitions, buckets, order = _layout(spark, name)
    bins = materialize(file_bins(spark, name, int(target_file_mb * 1024 * 1024)), "bins")
    extent = bins.agg(F.max("bin").alias("last"), F.max("files").alias("most")).first()
    if extent["most"] is None or extent["most"] < 2:
        return spark.table(name)
    columns = spark.table(name).columns
    rows = spark.table(name).withColumn("_path", F.col("_metadata.file_path"))
    placed = (
        rows.join(bins.select(F.col("path").alias("_path"), F.col("bin").alias("_bin")), "_path")
        .repartitionById(extent["last"] + 1, F.col("_bin").cast("int"))
        .select(*columns)
    )
    staged = f"{name}_compacted_{uuid.uuid4().hex[:12]}"
    write_table(
        placed, staged, "errorifexists", fmt, path,
        partition_by=partitions, bucket_by=buckets, sort_by=order,
    )
    spark.sql(f"ALTER TABLE {name} SET LOCATION {quoted(path)}")
    for folder in spark.sql(f"SHOW PARTITIONS {name}").collect() if partitions else []:
        spec = _partition(folder["partition"])
        at = quoted(f"{path.rstrip('/')}/{folder['partition']}")
        spark.sql(f"ALTER TABLE {name} PARTITION ({spec}) SET LOCATION {at}")
    spark.sql(f"DROP TABLE {staged}")  # its files are the table's now
    spark.catalog.refreshTable(name)
    return spark.table(name)


@contextmanager
def on_shared_buckets(spark: SparkSession) -> Iterator[None]:
    """Within this block, joins may rest on buckets by some of their keys.

    Spark by default shuffles two tables bucketed by store again if they are joined by store and
    date. All rows of a store lie in one bucket on either side, so that is not needed; it is the
    default because buckets by few values would leave tasks idle. A plan is made when a result is
    computed, so compute it within the block.
    """
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def register_view(df: DataFrame, name: str) -> DataFrame:
    """Name a DataFrame for SQL in this session."""
    df.createOrReplaceTempView(name)
    return df.sparkSession.table(name)


def persist_view(spark: SparkSession, name: str, query: str) -> DataFrame:
    """Store a SQL query over tables under a name in the catalog."""
    spark.sql(f"CREATE OR REPLACE VIEW {name} AS {query}")
    return spark.table(name)


def preview(df: DataFrame, order: list[str], n: int = 10) -> DataFrame:
    """The first ``n`` rows in a stated order."""
    return df.orderBy(*order).limit(n)
