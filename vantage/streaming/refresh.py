"""Structured Streaming forms: an elevation strip, new filings, results with a lifetime."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vantage.functions import tiles
from vantage.functions.normalize import inches


def read_strips(spark: SparkSession, path: str, files: int = 1000) -> DataFrame:
    """A stream of image cells (row, col, feet) from Parquet files, ``files`` at a time, the north first; row gives the event time."""
    rows = spark.readStream.schema("row long, col long, feet double").option("maxFilesPerTrigger", files).parquet(path)
    return rows.withColumn("passed", F.timestamp_seconds(F.col("row")))


def end_strips(spark: SparkSession, path: str, rows: int, late: int = 0) -> None:
    """Says that an image of so many rows is complete: one cell of no height, so far south that every band has passed; its tile of zeros is dropped."""
    end = spark.range(1).select(F.lit(rows + late + 2 * tiles.SIDE).cast("long").alias("row"), F.lit(0).cast("long").alias("col"), F.lit(0.0).alias("feet"))
    end.write.mode("append").parquet(path)


def stream_tiles(strips: DataFrame, west: int = 910720, north: int = 275160, late: int = 0) -> DataFrame:
    """ke, kn and the tile's cells as (e, n, h_in) once its last row has passed; tiles of zeros are dropped.

    A tile is a window of 500 rows of event time, so its state goes when the watermark passes it:
    when a row more than ``late`` rows south of it has been seen, or ``end_strips``. Strips that come
    later than that are lost, so ``late`` is how far files may come out of order.
    """
    e, n = (F.col("col") + west).cast("int"), (F.lit(north) - F.col("row") - 1).cast("int")
    cells = strips.withWatermark("passed", f"{late} seconds").withColumns({"e": e, "n": n, "h_in": inches(F.col("feet")), "ke": tiles.tile_key(e), "kn": tiles.tile_key(n)})
    held = cells.groupBy(F.window("passed", f"{tiles.SIDE} seconds", startTime=f"{north % tiles.SIDE} seconds"), "ke", "kn")
    return held.agg(F.collect_list(F.struct("e", "n", "h_in")).alias("cells"), F.max("h_in").alias("most")).where("most > 0").select("ke", "kn", "cells")


def _versions(spark: SparkSession, out: str) -> list[int]:
    """Numbers of the batches whose table is complete, increasing."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    files = path(out).getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(path(out)):
        return []
    names = [f.getPath().getName() for f in files.listStatus(path(out))]
    return sorted(int(n[8:]) for n in names if n.startswith("version=") and files.exists(path(f"{out}/{n}/_SUCCESS")))


def current(spark: SparkSession, out: str) -> DataFrame:
    """The table that ``refresh`` completed last."""
    return spark.read.parquet(f"{out}/version={_versions(spark, out)[-1]}")


def refresh(spark: SparkSession, incoming: str, out: str, checkpoint: str, schema: str, key: str, stamp: str) -> None:
    """Takes what is new in ``incoming`` (JSON) and writes the newest row of each key as a new version in ``out``.

    A batch reads the version before its own and writes its own; one that is run again after a
    failure writes the same again. Readers take the last complete version, so none is ever changed
    under them. The two last versions stay.
    """

    def merge(batch: DataFrame, number: int) -> None:
        before = [v for v in _versions(spark, out) if v < number]
        known = spark.read.parquet(f"{out}/version={before[-1]}").unionByName(batch) if before else batch
        newest = known.groupBy(key).agg(F.max_by(F.struct(*known.columns), F.struct(stamp, F.xxhash64(*known.columns))).alias("r")).select("r.*")
        newest.write.mode("overwrite").parquet(f"{out}/version={number}")
        path = spark._jvm.org.apache.hadoop.fs.Path
        for old in before[:-1]:
            path(out).getFileSystem(spark._jsc.hadoopConfiguration()).delete(path(f"{out}/version={old}"), True)

    stream = spark.readStream.schema(schema).json(incoming)
    stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def alive(results: DataFrame, now: str) -> DataFrame:
    """Stored results (kind lite or full, stored_at) that haven't run out: three hours or thirty seconds."""
    life = F.when(F.col("kind") == "lite", F.expr("INTERVAL 3 HOURS")).otherwise(F.expr("INTERVAL 30 SECONDS"))
    return results.withColumn("expires_at", F.col("stored_at") + life).where(F.col("expires_at") > F.lit(now).cast("timestamp"))
