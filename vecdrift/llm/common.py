"""What the operators of this subpackage share: the shared folder, written
intermediate tables, and Arrow batches of bounded size."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words are maximal runs of anything but these white-space characters; the
#: same set that bytes.split() splits at.
WORD = r"[^\x20\x09-\x0D]+"

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"

FILTER_BITS = 24
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_own_dir: dict[str, str] = {}
_held: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset, a temporary one if
    Spark runs in one process (tests), else an error: executors would not share it."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.conf.get("spark.master", "").startswith("local") or "cluster" in spark.conf.get("spark.master"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dir:
        _own_dir[app] = "file://" + tempfile.mkdtemp(prefix="spark-")
    return _own_dir[app]


def materialize(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back. Cuts the lineage, and
    survives the loss of executors, as every executor can read the files. The
    shuffles behind it are deleted at the end of the write: nothing reads them again."""
    return in_turn([df])


def in_turn(parts: list[DataFrame]) -> DataFrame:
    """materialize() for the union of parts of the same columns, of which one is
    written after another: the disk holds the shuffles of one part at a time."""
    spark, schema = parts[0].sparkSession, parts[0].schema
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    if _held:
        _held[-1].append(path)
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        for df in parts:
            df.write.mode("append").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(schema).parquet(path)


class Scratch:
    """The tables that materialize() writes while this is open. close() deletes
    them; what was derived from them must be written by then."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    @contextmanager
    def open(self) -> Iterator[None]:
        _held.append(self.paths)
        try:
            yield
        finally:
            _held.pop()

    def close(self) -> None:
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        while self.paths:
            path = jvm.org.apache.hadoop.fs.Path(self.paths.pop())
            path.getFileSystem(conf).delete(path, True)


def joined_to_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, most: int = 10_000, longest: int = 1024) -> DataFrame:
    """rows joined with groups, which has one row per key and, as `size`, its
    number of rows. The keys of more than 1 / most of all rows (and 1,000) are
    fewer than `most`, of `longest` bytes each: they are broadcast, so that their
    rows stay where they are. The others' rows meet by a shuffle on the key."""
    bound = max(1_000, rows.count() // most)
    sized = F.octet_length(F.col(key)) <= longest if isinstance(groups.schema[key].dataType, (T.StringType, T.BinaryType)) else F.lit(True)
    hot = materialize(groups.where((F.col(size) > bound) & sized))
    if hot.isEmpty():
        return rows.join(groups, key)
    names = F.broadcast(hot.select(key))
    rest = rows.join(names, key, "left_anti").join(groups.join(names, key, "left_anti"), key)
    return rows.join(F.broadcast(hot), key).unionByName(rest)


def among(rows: DataFrame, number: str, wanted: DataFrame, wanted_number: str, out: str) -> DataFrame:
    """Adds `out`: false only where no row of wanted has the row's number (a long
    without nulls). A bitmap of 2 ** FILTER_BITS bits (2 MB at most, as rows of
    4 KB) goes to every task, so that rows surely not wanted need not be shuffled."""
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << FILTER_BITS)) + 1
    bits = wanted.select(place(wanted_number).alias("p")).groupBy(F.bitmap_bucket_number("p").alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("_bits"))
    at = F.bitmap_bit_position(place(number))
    byte = F.conv(F.hex(F.substring("_bits", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    found = rows.join(F.broadcast(bits), F.bitmap_bucket_number(place(number)) == F.col("_bucket"), "left")
    return found.withColumn(out, F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False))).drop("_bucket", "_bits")


def bounded_batches(spark: SparkSession, records: int = 4096, megabytes: int = 8) -> None:
    """Bound Arrow batches by rows and, as texts can be very long, by bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(records))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{megabytes}m")


def release_memory() -> None:
    """Gives memory that is free in this process back to the system; Python workers
    live on after a task, and the next stage needs the room."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, for mapInArrow, which leaves little memory taken behind."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release_memory()

    return tidied


def text_bytes(text: str = "text") -> Column:
    """The text as UTF-8 bytes; null is the empty text."""
    return F.coalesce(F.col(text), F.lit("")).cast("binary")


def pieces_of(batch: pa.RecordBatch, rows: int = 256, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch, none of much more than `size` bytes unless it is a
    single row."""
    start, held = 0, 0
    column = batch.column("text")
    for i in range(batch.num_rows):
        held += len(column[i].as_buffer()) if column[i].is_valid else 0
        if held >= size or i + 1 - start >= rows:
            yield batch.slice(start, i + 1 - start)
            start, held = i + 1, 0
    if start < batch.num_rows:
        yield batch.slice(start)


def gathered(batches: Iterator[pa.RecordBatch], rows: int = 20_000) -> Iterator[pa.RecordBatch]:
    """The same rows (small ones) in batches of at least `rows`, whatever the
    session's batch size is when the job runs."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            yield pa.concat_batches(held)
            held, n = [], 0
    if held:
        yield pa.concat_batches(held)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, UPPER, LOWER)


def remainder(doc_id: Column, mod: int) -> Column:
    """crc32 of doc_id as text, modulo mod (a null doc_id counts as empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % F.lit(mod)
