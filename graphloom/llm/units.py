"""Cutting texts into units that a byte-level BPE encodes independently.

A single space followed by a character that isn't white space always begins a pre-token, so the pieces between such
spaces can be encoded one by one, and equal pieces have equal ids. Units tile a text: every unit but a text's first one
begins with its space. A text that holds an added token of the tokenizer is left to the library as a whole.

A block of texts is handled as arrays: units are byte ranges, equal ones are numbered by a dictionary encoding, and only
distinct units become Python strings, if they aren't in the table of common units.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .words import buffers_of

#: Documents looked at for common units, and units taken from them: a bounded table that goes to every task.
COMMON_SAMPLE, COMMON_UNITS = 8000, 250_000
#: Longest common unit in bytes; longer ones are encoded where they occur.
COMMON_BYTES = 100
#: Bytes of text that a kernel handles at once; a longer text is a block of its own.
BLOCK_BYTES = 2 << 20
#: Units beyond the common ones that a task remembers.
RECENT_UNITS = 200_000
#: Units whose ids are put together at once.
RUN_UNITS = 100_000
#: Units that are encoded as one text.
JOINED = 500

_ASCII_WHITE = np.zeros(256, bool)
_ASCII_WHITE[[9, 10, 11, 12, 13, 32]] = True
#: White space beyond ASCII, in UTF-8, by its first bytes.
_WHITE_TWO = {(0xC2, 0x85), (0xC2, 0xA0)}
_WHITE_THREE = {tuple(chr(c).encode()) for c in (0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)}


def unit_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sorted byte offsets at which units begin, in texts at ``offsets``."""
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets[:-1][np.diff(offsets) > 0]] = True
    at = np.flatnonzero(data[:-1] == 32) if len(data) else np.zeros(0, np.int64)
    at = at[~edge[at + 1]]  # a space that ends its text has nothing to begin
    after = data[at + 1]
    white = _ASCII_WHITE[after]
    for k in np.flatnonzero((after == 0xC2) | (after == 0xE1) | (after == 0xE2) | (after == 0xE3)).tolist():
        p = int(at[k])
        white[k] = tuple(data[p + 1 : p + 3].tolist()) in _WHITE_TWO or tuple(data[p + 1 : p + 4].tolist()) in _WHITE_THREE
    edge[at[~white]] = True
    return np.flatnonzero(edge[:-1])


def ragged(sizes: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions, ends) that gather rows ``of`` of a ragged array with rows of these sizes."""
    begin = np.r_[0, np.cumsum(sizes)]
    n = sizes[of]
    ends = np.r_[0, np.cumsum(n)]
    return np.arange(int(ends[-1])) + np.repeat(begin[of] - ends[:-1], n), ends


def _binary(data: bytes | np.ndarray, ends: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(data)])


class Table:
    """Units and their ids: a binary column, the ids one after the other, and how many each unit has."""

    def __init__(self, units: pa.Array, ids: np.ndarray, sizes: np.ndarray):
        self.units, self.ids, self.sizes = units, ids, sizes

    @classmethod
    def empty(cls, kind: str) -> Table:
        return cls(pa.array([], pa.binary()), np.zeros(0, kind), np.zeros(0, np.int64))

    def packed(self) -> tuple[bytes, bytes, bytes, bytes, str]:
        data, offsets = buffers_of(self.units)
        return data.tobytes(), np.diff(offsets).astype(np.int32).tobytes(), self.ids.tobytes(), self.sizes.astype(np.int32).tobytes(), self.ids.dtype.str

    @classmethod
    def unpacked(cls, parts: tuple[bytes, bytes, bytes, bytes, str]) -> Table:
        ends = np.r_[0, np.cumsum(np.frombuffer(parts[1], np.int32), dtype=np.int64)]
        return cls(_binary(parts[0], ends), np.frombuffer(parts[2], parts[4]), np.frombuffer(parts[3], np.int32).astype(np.int64))


class Encoder:
    """The tokenizers library's encoder, without special tokens, truncation and padding."""

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.path = path
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values() if t.content]
        self._spaced: np.ndarray | None = None

    @property
    def id_type(self) -> str:
        return "<u2" if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4"

    def texts(self, texts: list[str]) -> list[list[int]]:
        out: list[list[int]] = []
        for at in range(0, len(texts), 2000):  # the library's encodings are large
            out += [x.ids for x in self.tokenizer.encode_batch_fast(texts[at : at + 2000], add_special_tokens=False)]
        return out

    @property
    def spaced(self) -> np.ndarray:
        """Which ids begin with a space, U+0120 in a byte-level vocabulary."""
        if self._spaced is None:
            name = self.tokenizer.id_to_token
            self._spaced = np.array([(name(k) or "")[:1] == "\u0120" for k in range(self.tokenizer.get_vocab_size(with_added_tokens=True))])
        return self._spaced

    def units(self, units: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids one after the other, ids of each unit) of a binary column of distinct units.

        Units whose only space is their first byte are encoded many as one text; the ids that begin with a space tell
        them apart again.
        """
        data, offsets = buffers_of(units)
        n, kind = len(units), self.id_type
        if not n:
            return np.zeros(0, kind), np.zeros(0, np.int64)
        spaces = np.add.reduceat(np.r_[data == 32, False].astype(np.int64), offsets[:-1])
        plain = (spaces == 1) & (data[offsets[:-1]] == 32)
        sizes, parts, order = np.zeros(n, np.int64), [], []
        alone = np.flatnonzero(~plain)
        if len(alone):
            found = self.texts([str(data[offsets[k] : offsets[k + 1]].tobytes(), "utf-8", "replace") for k in alone.tolist()])
            sizes[alone] = [len(x) for x in found]
            parts += [np.array(x, kind) for x in found]
            order.append(alone)
        whole = np.flatnonzero(plain)
        if len(whole):
            pick, ends = ragged(np.diff(offsets), whole)
            joined, cuts = data[pick].tobytes(), ends[[*range(0, len(whole), JOINED), len(whole)]].tolist()
            for at in range(0, len(cuts) - 1, 20):
                own = cuts[at : at + 21]
                for ids in self.texts([str(joined[a:b], "utf-8", "replace") for a, b in zip(own[:-1], own[1:], strict=True)]):
                    parts.append(np.array(ids, kind))
            flat = np.concatenate(parts[len(alone) :])
            first = np.flatnonzero(self.spaced[flat])
            if len(first) != len(whole):
                raise ValueError("ids don't tell the units apart")
            sizes[whole] = np.diff(np.r_[first, len(flat)])
            order.append(whole)
        done = np.concatenate(order)
        back = np.empty(n, np.int64)
        back[done] = np.arange(n)
        flat = np.concatenate(parts) if parts else np.zeros(0, kind)
        pick, _ = ragged(sizes[done], back)
        return flat[pick], sizes


class Block:
    """The units of a block of texts: distinct ones, which of them stand where, and how many each text has."""

    def __init__(self, texts: pa.Array, added: list[bytes]):
        data, offsets = buffers_of(texts)
        self.whole: dict[int, str] = {}  # texts with an added token
        body = data.tobytes() if added else b""
        if any(x in body for x in added):
            for k in range(len(offsets) - 1):
                own = body[offsets[k] : offsets[k + 1]]
                if any(x in own for x in added):
                    self.whole[k] = str(own, "utf-8", "replace")
        starts = unit_starts(data, offsets)
        units = _binary(data, np.r_[starts, len(data)]).dictionary_encode()
        self.distinct, self.of = units.dictionary, units.indices.to_numpy()
        self.begin = np.searchsorted(starts, offsets)  # units of text k: begin[k] to begin[k + 1]

    def ids(self, encoder: Encoder, tables: list[Table]) -> tuple[Table, np.ndarray]:
        """(units that no table holds, for each distinct unit its place in the tables and these, one after the other)."""
        where, offset = np.full(len(self.distinct), -1, np.int64), 0
        for table in tables:
            left = np.flatnonzero(where < 0)
            if len(left) and len(table.units):
                found = pc.index_in(self.distinct.take(pa.array(left)), value_set=table.units)
                found = found.fill_null(-1).to_numpy().astype(np.int64)
                where[left] = np.where(found >= 0, found + offset, -1)
            offset += len(table.units)
        missing = np.flatnonzero(where < 0)
        new = self.distinct.take(pa.array(missing))
        where[missing] = offset + np.arange(len(missing))
        return Table(new, *encoder.units(new)), where


class Coder:
    """Ids of blocks of texts, with a table of common units and a bounded one of units met in this task."""

    def __init__(self, path: str, usual: tuple, limit: int = RECENT_UNITS):
        self.encoder, self.usual, self.limit = Encoder(path), Table.unpacked(usual), limit
        self.recent = Table.empty(self.encoder.id_type)

    def arrays(self, texts: pa.Array, more: Table | None = None) -> Iterator[np.ndarray]:
        """The ids of each text, in order; they are put together for a run of texts at a time."""
        block = Block(texts, self.encoder.added)
        tables = [self.usual, self.recent, *([more] if more else [])]
        new, where = block.ids(self.encoder, tables)
        flat, sizes = (np.concatenate([*(getattr(t, k) for t in tables), getattr(new, k)]) for k in ("ids", "sizes"))
        if len(self.recent.units) + len(new.units) <= self.limit:
            units = pa.concat_arrays([self.recent.units, new.units])
            self.recent = Table(units, np.r_[self.recent.ids, new.ids], np.r_[self.recent.sizes, new.sizes])
        whole = dict(zip(block.whole, self.encoder.texts([*block.whole.values()]), strict=True)) if block.whole else {}
        of, begin, at = where[block.of], block.begin, 0
        del block, new, where, tables
        while at < len(begin) - 1:
            end = max(at + 1, int(np.searchsorted(begin, begin[at] + RUN_UNITS, side="right")) - 1)
            pick, ends = ragged(sizes, of[begin[at] : begin[end]])
            ids, cuts = flat[pick], ends[begin[at : end + 1] - begin[at]].tolist()
            del pick, ends
            for k in range(at, end):
                yield np.array(whole[k], flat.dtype) if k in whole else ids[cuts[k - at] : cuts[k - at + 1]]
            at = end


def text_blocks(batches, limit: int = BLOCK_BYTES):
    """Runs of rows of Arrow batches (text in column 0) of about ``limit`` bytes of text."""
    for table in common.chunks(batches, 0, limit):
        yield table.combine_chunks()


def common_units(docs: DataFrame, path: str, sample: int = COMMON_SAMPLE, limit: int = COMMON_UNITS) -> Table:
    """Units that occur in most of a bounded sample of documents, each encoded once: no more than ``limit``."""
    spark = docs.sparkSession
    ids = [r[0] for r in docs.where("doc_id is not null").select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).collect()]
    if not ids:
        return Table.empty(Encoder(path).id_type)

    def count(batches):
        encoder = Encoder(path)
        for block in text_blocks(batches):
            own = Block(block.column(0).combine_chunks(), encoder.added)
            keep = np.flatnonzero(np.asarray(pc.binary_length(own.distinct)) <= COMMON_BYTES)
            n = np.bincount(own.of, minlength=len(own.distinct))[keep]
            yield pa.RecordBatch.from_arrays([own.distinct.take(pa.array(keep)), pa.array(n, pa.int64())], names=["unit", "n"])

    def encode(batches):
        encoder = Encoder(path)
        for batch in batches:
            found, sizes = encoder.units(batch.column(0))
            ends = np.r_[0, np.cumsum(sizes)] * found.itemsize
            yield pa.RecordBatch.from_arrays([batch.column(0), _binary(found.tobytes(), ends)], names=["unit", "ids"])

    drawn = docs.join(F.broadcast(common.rows_of(spark, [(k,) for k in ids], pa.schema([("of", pa.int64())]))), F.col("doc_id") == F.col("of"), "left_semi")
    units = drawn.select(F.col("text").cast("binary").alias("text")).mapInArrow(count, "unit binary, n long").groupBy("unit").agg(F.sum("n").alias("n"))
    units = units.orderBy(F.desc("n"), "unit").limit(limit).select("unit").repartition(1 + limit // 100_000)  # a tokenizer takes a while to load
    table = units.mapInArrow(encode, "unit binary, ids binary").toArrow().combine_chunks()
    data, offsets = buffers_of(table.column(1))
    kind = np.dtype(Encoder(path).id_type)
    units = table.column(0).combine_chunks()
    units = units if isinstance(units, pa.Array) else (units.chunk(0) if units.num_chunks else pa.array([], pa.binary()))
    return Table(units.cast(pa.binary()), np.frombuffer(data.tobytes(), kind), np.diff(offsets) // kind.itemsize)


def id_pieces(path: str) -> list[bytes]:
    """id -> bytes for every id of a byte-level vocabulary (its size bounds this table)."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in plain}
    byte_of |= {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}
    vocab = dict(spec["model"]["vocab"])
    added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    pieces = [b""] * (1 + max([*vocab.values(), *added.values()]))
    for piece, k in vocab.items():
        pieces[k] = bytes(byte_of[c] for c in piece) if piece not in added and all(c in byte_of for c in piece) else piece.encode()
    for piece, k in added.items():
        pieces[k] = piece.encode()
    return pieces
