"""What the operators of this subpackage share: inputs, lineage cuts, hot-key helpers."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space of the text contracts: a space and the characters 9 to 13.
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; our own one only where none is set (tests, one machine)."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = "file://" + tempfile.mkdtemp(prefix="quiverlake-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it again: lineage ends here, and any executor can be lost."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quiverlake/{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def unused(df: DataFrame, name: str) -> str:
    """name, lengthened until df has no such column."""
    held = {c.lower() for c in df.columns}
    while name.lower() in held:
        name += "_"
    return name


def text_of(c: str = "text") -> Column:
    """The whole text; null counts as empty."""
    return F.coalesce(F.col(c).cast("string"), F.lit(""))


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """crc32 of the id's decimal text, modulo; a null id is held out of nothing."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def arrow_schema(schema: str | T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(T._parse_datatype_string(schema) if isinstance(schema, str) else schema)


def most_frequent(counted: DataFrame, key: str, size: int) -> DataFrame:
    """(key): at most ``size`` of the most frequent keys of (key, n), n > 0, a table; no task or driver meets the keys.

    Counts are ranked by eighths of an octave, and within one by slices of a hash of the key. A histogram over both
    (at most 512 x 256 cells) tells how many whole cells there is room for.
    """
    cells = counted.select(key, F.floor(F.log2("n") * 8).cast("int").alias("level"), F.pmod(F.xxhash64(key), F.lit(256)).cast("int").alias("slice"))
    room, last = size, None
    for r in sorted(cells.groupBy("level", "slice").agg(F.count(F.lit(1)).alias("rows")).collect(), key=lambda r: (-r.level, r.slice)):
        if r.rows > room:
            break
        room, last = room - r.rows, r
    if last is None:
        return cells.where(F.lit(False)).select(key)
    return cells.where((F.col("level") > last.level) | ((F.col("level") == last.level) & (F.col("slice") <= last.slice))).select(key)


def count_rows(df: DataFrame) -> int:
    return df.agg(F.count(F.lit(1))).first()[0]
