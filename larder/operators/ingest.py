"""Bronze layer: load metadata and the load log."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.functions.columns import row_hash


def with_ingest_metadata(
    df: DataFrame,
    source_path: str,
    system: str,
    description: str,
    batch_id: str,
    loaded_at: datetime,
    null_token: str | None = None,
) -> DataFrame:
    """Add the audit columns of one load. Time and batch come from the caller, once per run."""
    return df.withColumns(
        {
            "ingestion_timestamp": F.lit(loaded_at).cast("timestamp"),
            "source_file_path": F.lit(source_path),
            "source_system": F.lit(system),
            "ingestion_batch_id": F.lit(batch_id),
            "record_source": F.lit(description),
            "is_deleted": F.lit(False),
            "row_hash": row_hash(df.columns, null_token),
        }
    )


def lineage_row(
    df: DataFrame,
    table: str,
    full_name: str,
    source_file: str,
    source_path: str,
    loaded_at: datetime | str,
    load_type: str = "initial_load",
    status: str = "SUCCESS",
) -> DataFrame:
    """One log row for a load of ``df``."""
    return df.agg(F.count("*").alias("record_count")).select(
        F.lit(table).alias("table_name"),
        F.lit(full_name).alias("full_table_name"),
        F.lit(source_file).alias("source_file"),
        F.lit(source_path).alias("source_path"),
        "record_count",
        F.lit(str(loaded_at)).alias("load_timestamp"),
        F.lit(load_type).alias("load_type"),
        F.lit(status).alias("status"),
    )
