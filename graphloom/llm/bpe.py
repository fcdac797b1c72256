"""BPE encoding and decoding through a table of distinct words.

1. Words are cut at the spaces where byte-level BPE never merges (``units``). Common ones, from a bounded sample, are encoded
   once by a Spark job and go to all tasks. Each block (neighbouring rows of a file) notes its other distinct words: one
   row for each word and block, however often it occurs.
2. These rows are shuffled and sorted by word. Every distinct word is encoded once by the tokenizers library, and its
   ids go back to the blocks that hold it, as one dictionary per block in the shared folder.
3. Each block numbers its distinct words, joins their ids to the positions at which they stand, and decodes by joining
   the ids to the table of pieces; both joins gather array rows.

Blocks don't depend on how files are split over tasks, so a task that is run again finds the same dictionary. Nothing but
words and ids is shuffled, never a text: a row for each position would be several times the input.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .units import BLOCK_BYTES, Block, Coder, Encoder, Table, common_units, id_pieces, ragged
from .words import buffers_of

#: Documents looked at for common words, and words taken from them: a bounded table that goes to every task.
COMMON_SAMPLE, COMMON_WORDS = 16_000, 400_000
#: Distinct words that a task holds at once while it notes them.
NOTED_WORDS = 500_000


def _note_words(path: str, usual):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        added, known = Encoder(path).added, Table.unpacked(usual.value).units
        held: dict[int, pa.Array] = {}

        def rows():
            for block, words in held.items():
                yield pa.RecordBatch.from_arrays([words, pa.array(np.full(len(words), block))], names=["word", "block"])
            held.clear()

        for block, table in common.block_runs(batches, BLOCK_BYTES):
            words = Block(common.array(table, 0), added).distinct
            words = words.filter(pc.is_null(pc.index_in(words, value_set=known)))
            if block in held:
                words = pc.unique(pa.concat_arrays([held[block], words]))
            elif len(held) > 100:
                yield from rows()
            held[block] = words
            if sum(map(len, held.values())) > NOTED_WORDS:  # bounds memory; a word may then be noted twice
                yield from rows()
        yield from rows()

    return run


def _encode_words(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, last = Encoder(path), None
        for batch in batches:
            if not batch.num_rows:
                continue
            words = batch.column(0).dictionary_encode()
            distinct, of = words.dictionary, words.indices.to_numpy()
            again = last is not None and distinct[0].as_py() == last[0]  # sorted, so only the first can be
            ids, sizes = encoder.units(distinct.slice(1) if again else distinct)
            if again:
                ids, sizes = np.r_[last[1], ids], np.r_[len(last[1]), sizes]
            pick, ends = ragged(sizes, of)
            found = pa.Array.from_buffers(pa.binary(), len(of), [None, pa.py_buffer((ends * ids.itemsize).astype(np.int32).tobytes()), pa.py_buffer(ids[pick].tobytes())])
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(0), found], names=["block", "word", "ids"])
            last = (distinct[-1].as_py(), ids[len(ids) - int(sizes[-1]) :].copy())
        common.release()

    return run


def _dictionary(uri: str, block: int, kind: str) -> Table:
    words, ids, sizes = [], [], []
    for batch in common.read_block(uri, block, ["word", "ids"]):
        data, offsets = buffers_of(batch.column(1))
        words.append(batch.column(0).cast(pa.binary()))
        ids.append(np.frombuffer(data.tobytes(), kind))
        sizes.append(np.diff(offsets) // np.dtype(kind).itemsize)
    return Table(pa.concat_arrays(words), np.concatenate(ids), np.concatenate(sizes)) if words else Table.empty(kind)


class Pieces:
    """The id-to-piece table as arrays, and the one of ids in decimal."""

    def __init__(self, pieces: list[bytes]):
        self.piece, self.piece_sizes = np.frombuffer(b"".join(pieces), np.uint8), np.array([len(x) for x in pieces])
        names = [f"{k}," for k in range(len(pieces))]
        self.name, self.name_sizes = np.frombuffer("".join(names).encode(), np.uint8), np.array([len(x) for x in names])

    def decoded(self, ids: np.ndarray) -> str:
        return self.piece[ragged(self.piece_sizes, ids)[0]].tobytes().decode("utf-8", "replace")

    def joined(self, ids: np.ndarray) -> bytes:
        """Decimal ids, joined by commas."""
        return self.name[ragged(self.name_sizes, ids)[0]].tobytes()[:-1]


def _apply(path: str, uri: str, usual, vocabulary, digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, pieces, at, own = Coder(path, usual.value, 0), Pieces(vocabulary.value), None, None
        kinds = [pa.int64(), pa.int64(), pa.string() if digest else pa.list_(pa.int32()), pa.string()]
        names = ["doc_id", "n_tokens", *(("ids_sha256", "decoded_sha256") if digest else ("ids", "decoded"))]
        for block, table in common.block_runs(batches, BLOCK_BYTES):
            if block != at:
                at, own = block, None
                own = _dictionary(uri, block, coder.encoder.id_type)
            out, held = [], 0
            for doc_id, ids in zip(table.column(3).to_pylist(), coder.arrays(common.array(table, 0), own), strict=True):
                body = pieces.decoded(ids)
                if digest:
                    out.append((doc_id, len(ids), hashlib.sha256(pieces.joined(ids)).hexdigest(), hashlib.sha256(body.encode()).hexdigest()))
                else:
                    out.append((doc_id, len(ids), ids.astype(np.int32), body))
                    held += len(ids)
                if held > 1 << 18:
                    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], of) for k, of in enumerate(kinds)], names=names)
                    out, held = [], 0
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], of) for k, of in enumerate(kinds)], names=names)

    return run


def encode_decode(docs: DataFrame, tokenizer: str | None = None, digest: bool = False) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids (array of int) and decoded; with ``digest`` their sha256 instead.

    A null text is an empty text: no ids, an empty decoded text. Rows that repeat are each encoded. Added tokens in
    a text are encoded as the library does by default. Columns other than doc_id and text are ignored, whatever their
    names, an empty table gives an empty result. ``tokenizer`` is the path of a tokenizer file that every executor can read.
    """
    path = tokenizer or common.tokenizer_path()
    spark = docs.sparkSession
    docs = common.documents(docs)
    usual = spark.sparkContext.broadcast(common_units(docs, path, COMMON_SAMPLE, COMMON_WORDS).packed())
    docs = common.located(docs)
    words = docs.select("text", "block").mapInArrow(_note_words(path, usual), "word binary, block long")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    by_word = words.repartition(n, "word").sortWithinPartitions("word")
    coded = by_word.mapInArrow(_encode_words(path), "block long, word binary, ids binary")
    uri = common.write_blocks(coded)
    kinds = "doc_id long, n_tokens long, " + ("ids_sha256 string, decoded_sha256 string" if digest else "ids array<int>, decoded string")
    return docs.mapInArrow(_apply(path, uri, usual, spark.sparkContext.broadcast(id_pieces(path)), digest), kinds)


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(common.table(spark, sf_dir, "documents"), digest=True)
