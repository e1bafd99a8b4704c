"""Raw file sources."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from larder.sources.tables import materialize

FORMATS = ("csv", "json", "parquet")
CORRUPT, SOURCE = "_corrupt_record", "_source_file"


def read_raw(
    spark: SparkSession, path: str, fmt: str = "csv", schema: StructType | str | None = None
) -> DataFrame:
    """Read one raw source.

    Give a schema wherever it is known: without one, CSV needs an extra pass over the whole file
    to infer types, and letter codes such as ``StateHoliday`` may be read as numbers.
    """
    if fmt not in FORMATS:
        raise ValueError(f"unsupported file format {fmt!r}; expected one of {', '.join(FORMATS)}")
    reader = spark.read.format(fmt)
    if schema is not None:
        reader = reader.schema(schema)
    if fmt == "csv":
        reader = reader.option("header", True).option("inferSchema", schema is None)
    return reader.load(path)


def read_checked(
    spark: SparkSession, path: str, schema: StructType, fmt: str = "csv"
) -> tuple[DataFrame, DataFrame]:
    """The rows of a raw source that fit its schema, and the records that do not.

    A record does not fit if a value can't be converted or, in CSV, if it has too few or too many
    fields. Such rows would otherwise come through with NULLs in place of what they say. They come
    back as ``record``, the line itself, ``source_file``, and ``fields_read``, the number of
    columns that could be read. An empty field is a NULL that fits. Rows whose every record fits
    are read without loss; formats that state types, such as Parquet, have no others.
    """
    if fmt not in ("csv", "json"):
        rows = read_raw(spark, path, fmt, schema)
        return rows, spark.createDataFrame([], "record string, source_file string, fields_read int")
    kept = StructField(CORRUPT, StringType())
    reader = spark.read.format(fmt).schema(StructType([*schema.fields, kept]))
    reader = reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT)
    if fmt == "csv":
        reader = reader.option("header", True)
    name = F.when(F.col(CORRUPT).isNotNull(), F.col("_metadata.file_path")).alias(SOURCE)
    # Parsed once and written, as Spark can't tell what does not fit from a pruned read.
    rows = materialize(reader.load(path).select("*", name), "checked")
    filled = [F.col(c).isNotNull().cast("int") for c in schema.names]
    bad = rows.filter(F.col(CORRUPT).isNotNull()).select(
        F.col(CORRUPT).alias("record"),
        F.col(SOURCE).alias("source_file"),
        reduce(lambda a, b: a + b, filled).alias("fields_read"),
    )
    return rows.filter(F.col(CORRUPT).isNull()).drop(CORRUPT, SOURCE), bad
