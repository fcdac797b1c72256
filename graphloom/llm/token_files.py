"""Token ids as binary files: one shared zstandard dictionary, every document compressed on its own.

A set of files has shards ``part-NNNNNN.loom`` and the dictionary ``dictionary.zst``. A shard is

    magic 8 bytes | dictionary sha256 32 bytes | 1 if its documents have no doc_id, else 0: u64 | id width in bytes u8
    the compressed documents, one after the other
    index: for each document doc_id i64, offset u64, compressed bytes u64, ids u64, first id's position in the shard u64
    offset of the index u64

all little-endian. The index gives any document without reading the others. Shards hold ascending doc_id ranges,
and their numbers ascend with them, so the ids of all documents stand in doc_id order. Documents without a doc_id
come first, in shards of their own with negative numbers.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .units import Coder, Encoder, common_units, text_blocks

MAGIC = b"LOOMIDS1"
HEAD = "<8s32sQB"
HEAD_BYTES = struct.calcsize(HEAD)
ENTRY = np.dtype([("doc_id", "<i8"), ("offset", "<u8"), ("bytes", "<u8"), ("ids", "<u8"), ("start", "<u8")])
#: Documents whose serialised ids train the dictionary, slices spread over each of them and their bytes, and the size of
#: the dictionary. It only affects the size of the files.
DICTIONARY_SAMPLE, DICTIONARY_SLICES, SLICE_BYTES, DICTIONARY_BYTES = 400, 16, 4096, 64 << 10
#: Documents for each shard, about.
SHARD_DOCS = 20_000
#: Bytes of a shard that a reader takes at once; a longer document is taken by itself.
READ_BYTES = 4 << 20


def _fs(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _serialize(ids: np.ndarray, width: int) -> bytes:
    return ids.astype("<u2" if width == 2 else "<u4").tobytes()


def train_dictionary(arrays: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A zstandard dictionary; too few or too small samples give their own bytes as a plain-content dictionary."""
    import zstandard

    arrays = [a for a in arrays if a]
    try:
        return zstandard.train_dictionary(size, arrays).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(arrays)[-size:]


def _training_slices(path: str, usual, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(path, usual.value)
        for block in text_blocks(batches):
            out = []
            for ids in coder.arrays(block.column(0).combine_chunks()):
                data = _serialize(ids, width)
                last = max(0, len(data) - SLICE_BYTES)
                n = min(DICTIONARY_SLICES, -(-len(data) // SLICE_BYTES))
                out.append([data[at : at + SLICE_BYTES] for at in sorted({last * k // max(1, n - 1) // width * width for k in range(n)})])
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.list_(pa.binary()))], names=["slices"])

    return run


def _compress(path: str, usual, end_id: int, width: int, dictionary: bytes, bounds: list[int], null_shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        held = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        pack = zstandard.ZstdCompressor(level=3, dict_data=held, write_content_size=True)
        coder, edges, end = Coder(path, usual.value), np.asarray(bounds, np.int64), np.array([end_id])
        for block in text_blocks(batches):
            doc_ids, n, blobs = block.column(1).combine_chunks(), [], []
            for ids in coder.arrays(block.column(0).combine_chunks()):
                n.append(len(ids) + 1)
                blobs.append(pack.compress(_serialize(np.r_[ids, end], width)))
            shard = np.searchsorted(edges, np.asarray(doc_ids.fill_null(0)), side="right")
            for k in np.flatnonzero(np.asarray(doc_ids.is_null())).tolist():
                shard[k] = -1 - zlib.crc32(blobs[k]) % null_shards
            yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), doc_ids, pa.array(n, pa.int64()), pa.array(blobs, pa.binary())], names=["shard", "doc_id", "n", "blob"])

    return run


def _write_shards(uri: str, digest: bytes, width: int):
    """Shards arrive sorted; each is written under a name of its own attempt, and the row that names it commits it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _fs(uri)
        system.create_dir(base, recursive=True)
        state = {"shard": None}

        def close():
            entries = np.array(state["index"], ENTRY)
            at = state["at"]
            state["out"].write(entries.tobytes() + struct.pack("<Q", at))
            state["out"].close()
            return state["shard"], state["name"], len(entries), int(entries["ids"].sum())

        def done(row):
            return pa.RecordBatch.from_arrays([pa.array([x]) for x in row], schema=pa.schema([("shard", pa.int32()), ("file", pa.string()), ("docs", pa.int64()), ("ids", pa.int64())]))

        for batch in batches:
            for shard, doc_id, n, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if shard != state["shard"]:
                    if state["shard"] is not None:
                        yield done(close())
                    name = f"part-{shard:06d}-{uuid.uuid4().hex}.loom"
                    state = {"shard": shard, "name": name, "out": system.open_output_stream(f"{base}/{name}"), "index": [], "at": HEAD_BYTES, "ids": 0}
                    state["out"].write(struct.pack(HEAD, MAGIC, digest, int(shard < 0), width))
                state["out"].write(blob)
                state["index"].append((doc_id or 0, state["at"], len(blob), n, state["ids"]))
                state["at"] += len(blob)
                state["ids"] += n
        if state["shard"] is not None:
            yield done(close())

    return run


def read_shard(file, dictionary: bytes) -> Iterator[tuple[int | None, int, np.ndarray]]:
    """(doc_id, position of its first id in the shard, ids) of every document of an open shard, some MB at a time."""
    import zstandard

    magic, digest, nameless, width = struct.unpack(HEAD, file.read_at(HEAD_BYTES, 0))
    if magic != MAGIC or digest != hashlib.sha256(dictionary).digest():
        raise ValueError("not a shard of this dictionary")
    size = file.size()
    (at,) = struct.unpack("<Q", file.read_at(8, size - 8))
    unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary)) if dictionary else zstandard.ZstdDecompressor()
    index = np.frombuffer(file.read_at(size - 8 - at, at), ENTRY)
    ends = (index["offset"] + index["bytes"]).astype(np.int64)
    k = 0
    while k < len(index):
        first = int(index["offset"][k])
        last = max(k + 1, int(np.searchsorted(ends, first + READ_BYTES, side="right")))
        data = file.read_at(int(ends[last - 1]) - first, first)
        for doc_id, offset, n_bytes, n, start in index[k:last].tolist():
            ids = np.frombuffer(unpack.decompress(data[offset - first : offset - first + n_bytes]), "<u2" if width == 2 else "<u4").astype("<u4")
            if len(ids) != n:
                raise ValueError("a document's number of ids differs from its index")
            yield None if nameless else doc_id, start, ids
        k = last


def read_document(uri: str, file: str, doc_id: int) -> np.ndarray | None:
    """One document by its index entry: reads the header, the index and the document's own bytes."""
    import zstandard

    system, base = _fs(uri)
    with system.open_input_stream(f"{base}/dictionary.zst") as f:
        dictionary = f.read()
    with system.open_input_file(f"{base}/{file}") as f:
        _, digest, _, width = struct.unpack(HEAD, f.read_at(HEAD_BYTES, 0))
        if digest != hashlib.sha256(dictionary).digest():
            raise ValueError("not a shard of this dictionary")
        size = f.size()
        (at,) = struct.unpack("<Q", f.read_at(8, size - 8))
        index = np.frombuffer(f.read_at(size - 8 - at, at), ENTRY)
        found = index[index["doc_id"] == doc_id]
        if not len(found):
            return None
        blob = f.read_at(int(found[0]["bytes"]), int(found[0]["offset"]))
    unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary)) if dictionary else zstandard.ZstdDecompressor()
    return np.frombuffer(unpack.decompress(blob), "<u2" if width == 2 else "<u4").astype("<u4")


def write_token_files(docs: DataFrame, uri: str | None = None, tokenizer: str | None = None, end_id: int = 0, shard_docs: int = SHARD_DOCS) -> tuple[str, DataFrame]:
    """Write all documents; the folder, and the manifest: shard, file, docs, ids.

    Every whole text (null: empty) is encoded without special tokens and closed with ``end_id``. Rows stand in
    ascending doc_id, null first; rows that repeat a doc_id are kept, the shorter and then the bytewise smaller one
    first. Other columns are ignored. An empty table gives a manifest without rows. Common units of text are encoded
    once and go to all tasks; the dictionary is trained on slices spread over whole texts of a sample of documents.
    """
    path = tokenizer or common.tokenizer_path()
    spark = docs.sparkSession
    uri = uri or common.shared_dir(spark)
    docs = common.documents(docs)
    vocabulary = Encoder(path).tokenizer.get_vocab_size(with_added_tokens=True)
    width = 2 if max(vocabulary, end_id + 1) <= 1 << 16 else 4
    ids = docs.select("doc_id")
    rows, named = ids.agg(F.count("*"), F.count("doc_id")).first()
    usual = spark.sparkContext.broadcast(common_units(docs, path).packed())
    drawn = ids.where("doc_id is not null").orderBy(F.xxhash64("doc_id"), "doc_id").limit(DICTIONARY_SAMPLE).distinct()
    texts = docs.join(F.broadcast(drawn), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(DICTIONARY_SAMPLE)
    slices = texts.select(F.col("text").cast("binary").alias("text")).mapInArrow(_training_slices(path, usual, width), "slices array<binary>").collect()
    dictionary = train_dictionary(sorted(x for r in slices for x in r["slices"]))
    n_shards = max(1, -(-named // shard_docs))
    cuts = [k / n_shards for k in range(1, n_shards)]
    bounds = sorted({int(x) for x in ids.approxQuantile("doc_id", cuts, 0.1 / n_shards)}) if cuts else []
    system, base = _fs(uri)
    system.create_dir(base, recursive=True)
    with system.open_output_stream(f"{base}/dictionary.zst") as f:
        f.write(dictionary)
    null_shards = max(1, -(-(rows - named) // shard_docs))
    texts = docs.select(F.col("text").cast("binary").alias("text"), "doc_id")
    packed = texts.mapInArrow(_compress(path, usual, end_id, width, dictionary, bounds, null_shards), "shard int, doc_id long, n long, blob binary")
    tasks = max(1, min(n_shards + null_shards, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    placed = packed.repartition(tasks, "shard").sortWithinPartitions("shard", "doc_id", "n", "blob")
    written = placed.mapInArrow(_write_shards(uri, hashlib.sha256(dictionary).digest(), width), "shard int, file string, docs long, ids long")
    return uri, common.materialize(written)


def read_token_files(uri: str, manifest: DataFrame, with_ids: bool = True) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and, unless ``with_ids`` is false, ids of every document, from the files the manifest names.

    ``start`` counts the ids of all documents before it: shard totals (one row per shard) are prefix-summed.
    """
    spark = manifest.sparkSession
    shards = sorted((r["shard"], r["file"], r["ids"]) for r in manifest.collect())
    before, plan = 0, []
    for _, file, n in shards:
        plan.append((file, before))
        before += n
    jobs = common.rows_of(spark, plan, pa.schema([("file", pa.string()), ("before", pa.int64())]))
    jobs = jobs.repartition(max(1, len(plan)), "file") if plan else jobs
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())][: 5 if with_ids else 4]
    names = ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(kinds)]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _fs(uri)
        with system.open_input_stream(f"{base}/dictionary.zst") as f:
            dictionary = f.read()

        def flush(rows):
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=names)

        for batch in batches:
            for name, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with system.open_input_file(f"{base}/{name}") as f:
                    rows, held = [], 0
                    for doc_id, start, ids in read_shard(f, dictionary):
                        rows.append((doc_id, first + start, len(ids), zlib.crc32(ids.tobytes()), ids.astype(np.int32) if with_ids else None))
                        held += len(ids) if with_ids else 100
                        if held >= 1 << 20:
                            yield flush(rows)
                            rows, held = [], 0
                    yield flush(rows)
        common.release()

    return jobs.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if with_ids else ""))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    uri, manifest = write_token_files(common.table(spark, sf_dir, "documents"))
    return read_token_files(uri, manifest, with_ids=False)
