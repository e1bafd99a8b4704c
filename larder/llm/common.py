"""Helpers shared by the text operators."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

SPACES = r"[^\x20\x09-\x0D]+"  # fixed by the contract: a word is a run of anything but these


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def per_text(compute: Callable[[Iterable[bytes]], Iterable[tuple]], schema: str) -> Any:
    """An Arrow UDF from a text column to a struct: ``compute`` maps UTF-8 texts to tuples.

    A null text is passed as no bytes at all. ``compute`` is called once per batch, so it can
    share work between the texts of a batch.
    """
    struct = T._parse_datatype_string(schema)
    kinds = [to_arrow_type(field.dataType) for field in struct.fields]
    names = [field.name for field in struct.fields]

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            texts = [text or b"" for text in batch.cast(pa.large_binary()).to_pylist()]
            rows = list(compute(texts))
            columns = list(zip(*rows)) if rows else [()] * len(names)
            arrays = [pa.array(c, type=kind) for c, kind in zip(columns, kinds)]
            yield pa.StructArray.from_arrays(arrays, names=names)

    # The module postpones annotations; the UDF's kind is read from real ones.
    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, struct)


def once_per_process(key: str, make: Callable[[], Any]) -> Any:
    """A value that a worker process builds once and keeps for its later tasks."""
    store = sys.modules.setdefault("_larder_worker", types.ModuleType("_larder_worker"))
    if not hasattr(store, key):
        setattr(store, key, make())
    return getattr(store, key)


def hex64(column: Column) -> Column:
    """The 16 lower-case hexadecimal digits of a 64-bit number."""
    return F.lpad(F.lower(F.hex(column)), 16, "0")


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until ``df`` has no such column."""
    taken = {column.lower() for column in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def remainder(doc_id: Column, divisor: int) -> Column:
    """crc32 of the id as text, modulo ``divisor``; the fold of a document. A null id is ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % divisor
