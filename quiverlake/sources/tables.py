"""Tables in shared storage: lineage cuts, and the Parquet layout of an index."""

from __future__ import annotations

import json
import tempfile
import uuid
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession

from ..functions.codec import Calibration, IndexSpec


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which all executors share; one of our own only where it isn't set."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = "file://" + tempfile.mkdtemp(prefix="quiverlake-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def materialize(df: DataFrame, name: str = "table", partition_by: str | None = None) -> DataFrame:
    """Writes df to the shared folder and reads it again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quiverlake/{uuid.uuid4().hex}/{name}"
    (df.write.partitionBy(partition_by) if partition_by else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spec_row(spec: IndexSpec, **more) -> str:
    return json.dumps(asdict(spec) | more)


def spec_of(text: str) -> tuple[IndexSpec, dict]:
    held = json.loads(text)
    calibration = held.pop("calibration")
    own = {k: held.pop(k) for k in ("dim", "bits", "metric", "seed")}
    return IndexSpec(**own, calibration=Calibration(tuple(calibration["shift"]), tuple(calibration["scale"])) if calibration else None), held


def save(codes: DataFrame, spec: IndexSpec, path: str, cells: DataFrame | None = None, payloads: DataFrame | None = None, **more) -> None:
    """codes/ (by cell, if there are cells), cells/, payloads/ and meta/ under path."""
    spark = codes.sparkSession
    writer = codes.write.mode("errorifexists")
    (writer.partitionBy("cell") if cells is not None else writer).parquet(f"{path}/codes")
    if cells is not None:
        cells.write.parquet(f"{path}/cells")
    if payloads is not None:
        payloads.write.parquet(f"{path}/payloads")
    spark.createDataFrame([(spec_row(spec, **more),)], "spec string").coalesce(1).write.parquet(f"{path}/meta")


def load(spark: SparkSession, path: str) -> tuple[DataFrame, IndexSpec, DataFrame | None, dict]:
    spec, more = spec_of(spark.read.parquet(f"{path}/meta").first().spec)
    codes = spark.read.parquet(f"{path}/codes")
    return codes, spec, spark.read.parquet(f"{path}/cells") if "cell" in codes.columns else None, more
