"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import hashlib
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that a Python task hands back to Spark at once.
BATCH_ROWS = 4096
#: Characters of text that a Python task holds at once, besides one row.
BATCH_CHARS = 8_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sha256(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def words_of(text: str | None) -> list[bytes]:
    """The words ``[^\\x20\\x09-\\x0D]+``: bytes.split() splits at just these six characters."""
    return text.encode().split() if text else []


def slices(batch: pa.RecordBatch, column: str | None) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of at most BATCH_CHARS bytes of text, or one row."""
    if column is None:
        yield batch
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    at = total = 0
    for i, size in enumerate(sizes):
        if i > at and total + size > BATCH_CHARS:
            yield batch.slice(at, i - at)
            at, total = i, 0
        total += size
    if at < len(sizes):
        yield batch.slice(at)


def map_text(df: DataFrame, columns: list[str], schema: str, rows: Callable[[dict[str, list]], dict[str, list]], text: str | None = "text") -> DataFrame:
    """``rows`` over bounded pieces of a table: lists by column in, lists by column out."""
    names = [f.split(" ")[0] for f in schema.split(", ")]
    kinds = pa.schema([pa.field(n, _KINDS[f.split(" ")[1]]) for n, f in zip(names, schema.split(", "))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                out = rows(part.to_pydict())
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in kinds], schema=kinds)

    return df.select(*columns).mapInArrow(run, schema)


_KINDS = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary(), "double": pa.float64(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32())}


def one_row_a_group(df: DataFrame, named: DataFrame, key: str, text: str) -> DataFrame:
    """Of each group one row of ``df``: that of the least key, nulls last, and then of the least hash of its text. named: ``key``, th, root."""
    least = named.groupBy("root").agg(F.min(F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("k"), F.col("th").alias("h"))).alias("s"))
    chosen = least.select(F.col("s.k").alias("__k"), F.col("s.h").alias("__h"))
    kept = df.join(chosen, df[key].eqNullSafe(chosen["__k"]) & (F.xxhash64(df[text]) == chosen["__h"]), "left_semi")
    row = F.struct(*(F.col(f"`{c}`") for c in df.columns))
    once = kept.groupBy(F.col(key).alias("__k"), F.xxhash64(text).alias("__h")).agg(F.min_by(row, F.xxhash64(row)).alias("__row"))
    return once.select(*(F.col("__row").getField(c).alias(c) for c in df.columns))


def checkpoint_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; only where it is unset on a local master (tests) a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='sluice-')}"
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(found)
    return found


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder below spark.checkpoint.dir, which driver and executors share."""
    return f"{checkpoint_dir(spark)}/{uuid.uuid4().hex}"


def ship(df: DataFrame) -> tuple[str, ...]:
    """Have each executor that needs them fetch the rows' files, once; gives their names there. The rows do not pass the driver."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    files = df.sparkSession.read.schema(df.schema).parquet(path).inputFiles()
    for f in files:
        df.sparkSession.sparkContext.addFile(f)
    return tuple(f.rsplit("/", 1)[-1] for f in files)


def shipped(name: str) -> pa.Table:
    """In a task: the rows of a shipped file."""
    return pq.read_table(SparkFiles.get(name))


def durable(df: DataFrame) -> DataFrame:
    """The rows, computed once and written to the shared folder, so that a lost executor loses none of them."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
