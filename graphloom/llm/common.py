"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL: dict[str, str] = {}
#: Bytes of an Arrow batch that goes to Python, about.
BATCH_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder below the one the cluster shares (``spark.checkpoint.dir``).

    Only a session on a local master without that setting gets a temporary folder of this machine.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local":
            base = _LOCAL.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="loom-"))
        else:
            base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_loom"
    if "://" not in base and not base.startswith("file:"):
        default = spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS", "file:///")
        base = (default.rstrip("/") if not default.startswith("file:") else "file://") + base
    return f"{base.rstrip('/')}/loom-{uuid.uuid4().hex}"


def materialize(df: DataFrame, path: str | None = None, *partition_by: str) -> DataFrame:
    """Write a table into the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = path or shared_dir(spark)
    writer = df.write.mode("overwrite").option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Arrow batches to Python are bounded by bytes too, so that long texts don't fill a worker."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(re.sub("[^0-9]", "", spark.conf.get(key)) or 0) != BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def documents(df: DataFrame, *extra: str) -> DataFrame:
    """doc_id, text (null reads as empty) and the extra columns, whatever else the table holds."""
    small_batches(df.sparkSession)
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *[F.col(c) for c in extra])


def located(df: DataFrame, rows: int = 8192) -> DataFrame:
    """text (bytes, null reads as empty), block, row, doc_id of documents in files; other inputs are written to files first.

    row is the row's place in its file, block names ``rows`` neighbouring places of a file: both are the same in
    every read, however the files are split over tasks.
    """
    docs = documents(df)
    place = F.col("_metadata.row_index")
    block = F.xxhash64("_metadata.file_path", F.floor(place / rows)).alias("block")
    columns = [F.col("text").cast("binary").alias("text"), block, place.alias("row"), F.col("doc_id")]
    try:
        keyed = docs.select(*columns)
        keyed.schema  # noqa: B018
        return keyed
    except Exception as e:  # a table without file metadata
        if "UNRESOLVED" not in str(e) and "_metadata" not in str(e) and "FIELD_NOT_FOUND" not in str(e):
            raise
    return materialize(docs).select(*columns)


def array(table: pa.Table, k: int | str) -> pa.Array:
    """A column as one array."""
    column = table.column(k).combine_chunks()
    return column if isinstance(column, pa.Array) else column.chunk(0) if column.num_chunks else pa.array([], column.type)


def block_runs(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[tuple[int, pa.Table]]:
    """Rows of one block (column 1) at a time, in runs of about ``limit`` bytes of text (column 0)."""
    for table in chunks(batches, 0, limit):
        block = table.column(1).to_numpy()
        cuts = [0, *(np.flatnonzero(block[1:] != block[:-1]) + 1).tolist(), len(block)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if b > a:
                yield int(block[a]), table.slice(a, b - a)


def write_blocks(rows: DataFrame) -> str:
    """Write rows with a ``block`` for ``read_block``; the folder."""
    uri = shared_dir(rows.sparkSession)
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows.repartition(n, "block").write.option("compression", "zstd").partitionBy("block").parquet(uri)
    return uri


def read_block(uri: str, block: int, columns: list[str]) -> Iterator[pa.RecordBatch]:
    """What a block's files hold, from any executor."""
    import pyarrow.parquet as pq
    from pyarrow import fs

    system, base = fs.FileSystem.from_uri(uri)
    path = f"{base}/block={block}"
    if system.get_file_info(path).type == fs.FileType.NotFound:
        return
    for info in system.get_file_info(fs.FileSelector(path)):
        if info.base_name.endswith(".parquet"):
            with system.open_input_file(info.path) as f:
                yield from pq.ParquetFile(f).iter_batches(50_000, columns=columns)


def is_held_out(doc_id) -> F.Column:
    """crc32 of the id as decimal text, modulo 3, is 1; a null id counts as held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(True))


def chunks(batches: Iterator[pa.RecordBatch], column: str | int, limit: int = 8 << 20) -> Iterator[pa.Table]:
    """Group Arrow batches until their ``column`` holds about ``limit`` bytes, so kernels see bounded blocks.

    What a task's blocks took goes back to the system when they end: workers are used again by later stages.
    """
    held, size = [], 0
    try:
        for batch in batches:
            at = 0
            where = batch.schema.get_field_index(column) if isinstance(column, str) else column
            while at < batch.num_rows:
                part = batch.slice(at, 64)
                at += part.num_rows
                held.append(part)
                size += part.column(where).nbytes
                if size >= limit:
                    yield pa.Table.from_batches(held)
                    held, size = [], 0
        if held:
            yield pa.Table.from_batches(held)
    finally:
        held = None
        release()


def release() -> None:
    """Hand memory that isn't used any more back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass


def rows_of(spark: SparkSession, rows: list[tuple], schema: pa.Schema) -> DataFrame:
    """A small table of the driver; it goes through Arrow, so that no Python worker starts for it."""
    columns = [pa.array([r[k] for r in rows], field.type) for k, field in enumerate(schema)]
    return spark.createDataFrame(pa.Table.from_arrays(columns, schema=schema))


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def slot(column: str, bits: int) -> F.Column:
    return F.expr(f"cast(pmod(xxhash64({column}), {1 << bits}) as int)")


def _pack_slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    maps: dict[int, np.ndarray] = {}
    for batch in batches:
        at = batch.column(0).to_numpy()
        for s in np.unique(at >> 16):
            maps.setdefault(int(s), np.zeros(1 << 16, bool))[at[(at >> 16) == s] & 0xFFFF] = True
    for s, own in maps.items():
        yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([np.packbits(own).tobytes()])], names=["slice", "bits"])


def slot_bitmap(rows: DataFrame, column: str, bits: int):
    """A broadcast bitmap of 2^bits slots with those of a column's values set; its size is fixed, whatever the rows."""
    spark = rows.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    slots = rows.select(slot(column, bits).alias("slot")).distinct().repartition(n, F.shiftright("slot", 16))
    packed = slots.mapInArrow(_pack_slots, "slice int, bits binary").toArrow()
    out = bytearray(1 << (bits - 3))
    for s, own in zip(packed.column(0).to_pylist(), packed.column(1).to_pylist(), strict=True):
        out[s << 13 : (s + 1) << 13] = own
    return spark.sparkContext.broadcast(bytes(out))
