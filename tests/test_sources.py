import os
from datetime import datetime

import pytest
from conftest import SF, plan_of
from helpers import raw_rows
from pyspark.sql import functions as F

from larder import params as P
from larder.checks import spark_queries
from larder.operators import ingest
from larder.sources import files, panel, tables

AT = datetime(2024, 1, 1)


def test_csv_round_trip_with_schema(spark, tmp_path):
    rows = raw_rows(spark, {}, {"Sales": None, "StateHoliday": "a"}, {"Date": "2013-13-01"})
    path = str(tmp_path / "sales")
    rows.write.option("header", True).csv(path)
    back = files.read_raw(spark, path, schema=P.RAW_SALES)
    assert back.schema == P.RAW_SALES
    assert sorted(map(str, back.collect())) == sorted(map(str, rows.collect()))


def test_csv_infers_types_without_schema(spark, tmp_path):
    path = str(tmp_path / "sales")
    raw_rows(spark, {}).write.option("header", True).csv(path)
    assert dict(files.read_raw(spark, path).dtypes)["Store"] == "int"


@pytest.mark.parametrize("fmt", ["json", "parquet"])
def test_other_formats(spark, tmp_path, fmt):
    path = str(tmp_path / fmt)
    raw_rows(spark, {}).write.format(fmt).save(path)
    assert files.read_raw(spark, path, fmt, P.RAW_SALES).count() == 1


def test_records_that_do_not_fit_are_kept_apart(spark, tmp_path):
    good = raw_rows(spark, {}, {"Sales": None, "StateHoliday": "a"})
    path = str(tmp_path / "sales")
    good.write.option("header", True).csv(path)
    header = ",".join(good.columns)
    (tmp_path / "sales" / "more.csv").write_text(
        header + "\n" + "1,2\n" + "x,5,2013-01-01,1.0,2,1,0,0,0\n"
        + "1,5,2013-01-01,1.0,2,1,0,0,0,9,9\n" + "3,5,2013-01-02,7.0,2,1,0,b,0\n"
    )
    rows, rejected = files.read_checked(spark, path, P.RAW_SALES)
    assert rows.schema == P.RAW_SALES and rows.count() == 3
    assert sorted((r.record[:3], r.fields_read) for r in rejected.collect()) == [
        ("1,2", 2), ("1,5", 9), ("x,5", 8),
    ]
    assert all(r.source_file.endswith("more.csv") for r in rejected.collect())


@pytest.mark.parametrize("fmt", ["json", "parquet"])
def test_other_formats_are_checked(spark, tmp_path, fmt):
    path = str(tmp_path / fmt)
    raw_rows(spark, {}).write.format(fmt).save(path)
    if fmt == "json":
        (tmp_path / fmt / "more.json").write_text('{"Store": "x"}\n{"Sto\n')
    rows, rejected = files.read_checked(spark, path, P.RAW_SALES, fmt)
    assert (rows.count(), rejected.count()) == (1, 2 if fmt == "json" else 0)


def test_unknown_format_is_refused(spark):
    with pytest.raises(ValueError, match="xml"):
        files.read_raw(spark, "nowhere", "xml")


def test_overwrite_replaces_schema_and_append_adds_by_name(spark):
    tables.write_table(spark.range(3), "t_write")
    a = spark.createDataFrame([(1, "x")], "a int, b string")
    assert tables.write_table(a, "t_write").columns == ["a", "b"]
    swapped = spark.createDataFrame([("y", 2)], "b string, a int")
    after = tables.write_table(swapped, "t_write", mode="append")
    assert sorted(map(tuple, after.collect())) == [(1, "x"), (2, "y")]
    with pytest.raises(ValueError, match="columns"):
        tables.write_table(spark.range(1), "t_write", mode="append")


def test_append_under_a_path_survives_a_new_catalog(spark, tmp_path):
    path = str(tmp_path / "log")
    tables.write_table(spark.range(2), "t_log", mode="append", path=path)
    spark.sql("DROP TABLE t_log")
    assert tables.write_table(spark.range(3), "t_log", mode="append", path=path).count() == 5
    assert tables.write_table(spark.range(4), "t_log", mode="append", path=path).count() == 9


def test_properties_comments_and_statistics(spark):
    tables.write_table(spark.range(7), "t_tags")
    props = tables.set_properties(spark, "t_tags", {"quality.layer": "gold", "note": "it's"})
    stored = {r.key: r.value for r in props.collect()}
    assert stored["quality.layer"] == "gold" and stored["note"] == "it's"
    assert tables.set_comment(spark, "t_tags", "the store's own").first().comment == "the store's own"
    assert tables.analyze(spark, "t_tags").first().row_count == 7
    assert tables.analyze(spark, "t_tags", ["id"]).first().row_count == 7
    assert tables.analyze(spark, "t_tags", "all").first().size_in_bytes > 0


def test_compaction_keeps_rows_in_fewer_files(spark):
    tables.write_table(spark.range(1000).repartition(12), "t_compact")
    tables.set_comment(spark, "t_compact", "kept")
    assert len(spark.table("t_compact").inputFiles()) == 12
    after = tables.compact(spark, "t_compact", tables.shared_folder(spark, "compact"))
    assert len(after.inputFiles()) == 1
    assert after.agg(F.sum("id"), F.count("*")).first()[:] == (499500, 1000)
    assert tables.table_detail(spark, "t_compact", "Comment").first().comment == "kept"


LAYOUTS = {
    "buckets": {"bucket_by": (4, ["k"]), "sort_by": ["k", "id"]},
    "parts": {"partition_by": ["p"]},
    "both": {"partition_by": ["p"], "bucket_by": (3, ["k"])},
}


@pytest.mark.parametrize("layout", LAYOUTS)
@pytest.mark.parametrize("external", [False, True])
def test_compaction_keeps_the_layout(spark, tmp_path, layout, external):
    rows = spark.range(2000).selectExpr(
        "id", "id % 7 AS k", "CASE WHEN id % 3 < 2 THEN concat('x y/', id % 3) END AS p"
    )
    name = f"t_{layout}_{external}".lower()
    path = f"file://{tmp_path}/{name}" if external else None
    tables.write_table(rows.repartition(6), name, path=path, **LAYOUTS[layout])
    before, laid_out = len(spark.table(name).inputFiles()), tables._layout(spark, name)
    after = tables.compact(spark, name, tables.shared_folder(spark, "compacted"))
    groups = {"buckets": 3, "parts": 3, "both": 9}[layout]  # seven values of k fill three buckets
    assert (before, len(after.inputFiles())) == (6 * groups, groups)
    assert tables._layout(spark, name) == laid_out
    assert after.exceptAll(rows.select(*after.columns)).isEmpty() and after.count() == 2000
    if layout == "buckets":
        assert "Exchange" not in plan_of(after.groupBy("k").count())
    files = set(after.inputFiles())
    again = tables.compact(spark, name, tables.shared_folder(spark, "compacted"))
    assert set(again.inputFiles()) == files  # nothing to put together, nothing written


def test_bins_hold_a_target_and_one_file_more(spark):
    tables.write_table(spark.range(30_000).repartition(30), "t_bins", bucket_by=(2, ["id"]))
    bins = tables.file_bins(spark, "t_bins", 20_000)
    whole = bins.groupBy("bin", "bucket").agg(F.sum("size").alias("s"), F.max("size").alias("m"))
    assert whole.count() == bins.select("bin").distinct().count() > 4
    assert whole.filter("s > 20000 + m").isEmpty()
    assert bins.agg(F.sum("rows"), F.max("bin")).first()[0] == 30_000
    target = 20_000 / (1 << 20)
    after = tables.compact(spark, "t_bins", tables.shared_folder(spark, "bins"), target)
    assert len(after.inputFiles()) == whole.count() and after.agg(F.sum("id")).first()[0] == 449_985_000
    assert "Exchange" not in plan_of(after.groupBy("id").count())


def test_compaction_shuffles_by_file_alone(spark, monkeypatch):
    tables.write_table(spark.range(500).repartition(5), "t_by_file", bucket_by=(2, ["id"]))
    plans = []
    write = tables.write_table
    monkeypatch.setattr(
        tables, "write_table", lambda df, *a, **k: (plans.append(plan_of(df)), write(df, *a, **k))[1]
    )
    tables.compact(spark, "t_by_file", tables.shared_folder(spark, "by_file"))
    assert "_bin" in plans[0] and "hashpartitioning(id" not in plans[0] and "rangepartitioning" not in plans[0]


@pytest.mark.parametrize("external", [False, True])
def test_a_retried_batch_changes_nothing(spark, tmp_path, external):
    name, path = f"t_batches_{external}".lower(), f"file://{tmp_path}/batches" if external else None

    def append(batch, n):
        rows = spark.range(n).select(F.lit(batch).alias("batch"), "id")
        return tables.append_batch(rows, name, "batch", path=path)

    for batch, n in (("none", 0), ("a", 3), ("b", 9), ("b", 4), ("b", 4), ("c d/e", 2)):
        saved = append(batch, n)
    assert {r.batch: r["count"] for r in saved.groupBy("batch").count().collect()} == {
        "a": 3, "b": 4, "c d/e": 2,
    }
    assert saved.columns == ["id", "batch"]
    with pytest.raises(ValueError, match="columns"):
        tables.append_batch(spark.range(1), name, "batch", path=path)
    assert append("d", 0).count() == 9
    if external:  # a new catalog knows nothing of the table
        spark.sql(f"DROP TABLE {name}")
        assert append("e", 1).count() == 10
    fresh = tables.append_batch(spark.range(2).withColumn("batch", F.lit("x")), name, "batch", "overwrite", path=path)
    assert fresh.count() == 2


def test_a_failed_try_leaves_the_table_as_it_was(spark):
    rows = spark.range(5).withColumn("batch", F.lit("a"))
    tables.append_batch(rows, "t_failed", "batch")
    broken = rows.withColumn("id", F.when(F.col("id") < 4, F.col("id")).otherwise(F.raise_error(F.lit("no")).cast("long")))
    with pytest.raises(Exception, match="no"):
        tables.append_batch(broken, "t_failed", "batch").count()
    assert spark.table("t_failed").agg(F.sum("id")).first()[0] == 10


def test_batches_need_a_table_that_keeps_them_apart(spark):
    tables.write_table(spark.range(2).withColumn("batch", F.lit("a")), "t_flat")
    with pytest.raises(ValueError, match="apart"):
        tables.append_batch(spark.range(2).withColumn("batch", F.lit("a")), "t_flat", "batch")


def test_layers_and_views(spark):
    names = {r.namespace for r in tables.ensure_layers(spark).collect()}
    assert set(P.LAYERS) <= names
    tables.register_view(spark.range(5), "v_session")
    assert spark.sql("SELECT count(*) AS n FROM v_session").first().n == 5
    tables.write_table(spark.range(4), "t_under_view")
    view = tables.persist_view(spark, "v_stored", "SELECT id * 2 AS twice FROM t_under_view")
    assert view.agg(F.max("twice")).first()[0] == 6


def test_preview_is_ordered(spark):
    rows = tables.preview(spark.range(100).orderBy(F.desc("id")), ["id"], 3).collect()
    assert [r.id for r in rows] == [0, 1, 2]


def test_materialize_reads_back_what_it_wrote(spark):
    df = spark.range(10).withColumn("x", F.col("id") * 0.5)
    back = tables.materialize(df)
    assert back.dtypes == df.dtypes and back.count() == 10
    assert back.inputFiles()[0].removeprefix("file://").startswith(
        spark.conf.get("spark.checkpoint.dir")
    )


def test_ingest_metadata_and_lineage(spark):
    raw = raw_rows(spark, {}, {"Store": 2})
    loaded = ingest.with_ingest_metadata(raw, "in/sales.csv", "shop", "sales", "b1", AT)
    assert loaded.columns == [f.name for f in P.RAW_SALES] + P.INGEST_COLUMNS
    row = loaded.first()
    assert row.ingestion_timestamp == AT and row.is_deleted is False and len(row.row_hash) == 64
    entry = ingest.lineage_row(raw, "raw_sales", "bronze.raw_sales", "sales.csv", "in/", AT).first()
    assert entry.record_count == 2 and entry.load_type == "initial_load"


def test_panel_has_one_row_per_store_and_day(spark):
    days = panel.store_days(spark, SF)
    assert days.groupBy("Store", "Date").count().filter("count > 1").isEmpty()
    assert days.filter("Sales * 8 <> floor(Sales * 8)").isEmpty()
    raw = panel.raw_sales(spark, SF)
    assert raw.count() > days.count()
    assert set(raw.columns) == {f.name for f in P.RAW_SALES}


def test_release_removes_later_steps_only(spark):
    first = tables.materialize(spark.range(3))
    before = tables.steps(spark)
    second = tables.materialize(spark.range(4))
    assert tables.steps(spark) == before + 1 and second.count() == 4
    folder = second.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
    assert tables.release(spark, keep=before) == 1
    assert not os.path.exists(folder) and first.count() == 3
    assert tables.steps(spark) == before


def test_many_order_lines_are_dealt_out_in_tasks_of_a_bounded_size(spark, tmp_path, monkeypatch):
    lines = spark.range(5000).select(
        (F.col("id") % 9).alias("l_suppkey"),
        F.timestamp_seconds(F.col("id") * 7000).alias("l_shipdate"),
        (F.col("id") % 13 + 0.5).alias("l_extendedprice"),
        (F.col("id") % 5).cast("double").alias("l_quantity"),
        F.lit(0.05).alias("l_discount"),
    )
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    few = panel.store_days(spark, str(tmp_path)).collect()
    monkeypatch.setattr(panel, "MANY_LINES", 1000)
    monkeypatch.setattr(panel, "LINES_A_TASK", 500)
    assert panel.tasks(spark, str(tmp_path)) == 10
    many = panel.store_days(spark, str(tmp_path))
    assert many.rdd.getNumPartitions() == 10  # not put together again
    assert sorted(many.collect()) == sorted(few)


def test_buckets_follow_the_number_of_tasks(spark, monkeypatch):
    monkeypatch.setattr(panel, "MANY_LINES", 1000)
    monkeypatch.setattr(panel, "LINES_A_TASK", 500)
    written = []
    save = spark_queries.saved
    monkeypatch.setattr(
        spark_queries, "saved", lambda df, name, **layout: written.append(layout["bucket_by"][0]) or save(df, name, **layout)
    )
    rows = spark_queries.enrich_predictions_bucketed(spark, SF)
    assert written == [panel.tasks(spark, SF)] * 2 and written[0] > 4
    spark_queries.forget()
    monkeypatch.undo()
    assert sorted(rows.collect()) == sorted(spark_queries.enrich_predictions(spark, SF).select(*rows.columns).collect())
