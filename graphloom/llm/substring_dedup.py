"""Removal of repeated passages with prefix-partitioned suffix trees over words.

Suffixes are told apart by their first ``window`` words, the depth from which a node means a repeated passage. They are
partitioned by words they begin with or hold early: the ``gram``-tuple of least rank among the first ``window`` words, so
equal windows meet, and neighbouring suffixes with the same tuple, its leaves, travel as one stretch of text.

1. A counting pass over all tuples names, for each block of documents, those that occur in several documents; no window
   with another one is repeated. A tuple with too many leaves for one memory-sized group has its prefix grow to the
   whole window, one leaf for each suffix.
2. Leaves of shared tuples are sent as the words themselves. Within a block of text, a leaf that repeats in a larger
   document is decided at once, by comparing the texts, so a passage that a third of all documents hold arrives as one
   row for each block.
3. Each group is a subtree: its suffixes are sorted by naming 1, 2, 4, ... words (prefix doubling), neighbours get the
   length of their common prefix, and a run with common prefixes of ``window`` words or more hangs below one deep
   internal node. Its smallest document keeps the passage, the others lose it.
4. The lost ranges, maximal repeats where they touch, go back to their blocks as files; texts are never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .words import A, B, Words, mix, rolling, slices

WINDOW, GRAM = 13, 5
#: Leaves of a tuple beyond which its prefix grows to whole windows.
FREQUENT = 20_000
#: Bytes of text whose leaves are handled at once, and leaves sorted at once.
BLOCK_BYTES, GROUP_ROWS = 4 << 20, 30_000
#: Repeated leaves whose texts a task remembers having sent.
SENT_LEAVES = 20_000


class Leaves:
    """Leaves of a block of documents: neighbouring suffixes with the same tuple.

    at, n: first window, as a word of the block, and number of windows; anchor: the tuple's digest; text: which text it
    is in; first: its word there.
    """

    def __init__(self, texts: pa.Array, window: int, gram: int):
        self.words = Words(texts)
        h, doc = self.words.digests(), self.words.doc
        self.windows, grams = rolling(h, window, A), rolling(h, gram, B)
        total = len(self.windows)
        self.at = self.n = self.text = self.first = np.zeros(0, np.int64)
        self.anchor = np.zeros(0, np.uint64)
        if not total:
            return
        least, where = grams[:total].copy(), np.zeros(total, np.int8)
        for k in range(1, window - gram + 1):
            own = grams[k : k + total]
            less = own < least
            least[less], where[less] = own[less], k
        at = np.flatnonzero(doc[:total] == doc[window - 1 : window - 1 + total])
        if not len(at):
            return
        anchor_at = at + where[at]
        new = np.r_[True, (anchor_at[1:] != anchor_at[:-1]) | (at[1:] != at[:-1] + 1)]
        first = np.flatnonzero(new)
        self.at, self.n = at[first], np.diff(np.r_[first, len(at)])
        self.anchor, self.text = least[self.at], doc[self.at]
        self.first = self.at - self.words.begin[self.text]


def _count_anchors(window: int, gram: int):
    """anchor, block, the least document that holds it there, and twice its leaves there, plus 1 if others hold it too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, table in common.block_runs(batches, BLOCK_BYTES):
            leaves = Leaves(common.array(table, 0), window, gram)
            if not len(leaves.at):
                continue
            doc_ids = table.column(3).to_numpy()[leaves.text]
            order = np.lexsort((doc_ids, leaves.anchor))
            anchor, doc_id = leaves.anchor[order], doc_ids[order]
            first = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
            n = np.diff(np.r_[first, len(anchor)])
            several = doc_id[first + n - 1] > doc_id[first]
            for k in range(0, len(first), 50_000):
                s = slice(k, k + 50_000)
                own = first[s]
                yield pa.RecordBatch.from_arrays([pa.array(anchor[own].view(np.int64)), pa.array(np.full(len(own), block)), pa.array(doc_id[own]), pa.array((2 * n[s] + several[s]).astype(np.int64))], names=["anchor", "block", "low", "leaves"])

    return run


def _shared_anchors(frequent: int):
    """Rows sorted by anchor to (block, anchor, whether it is frequent) of those that several documents hold."""

    def told(anchor: np.ndarray, block: np.ndarray, low: np.ndarray, leaves: np.ndarray) -> pa.RecordBatch:
        first = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
        shared = (np.minimum.reduceat(low, first) < np.maximum.reduceat(low, first)) | (np.maximum.reduceat(leaves & 1, first) > 0)
        often = np.add.reduceat(leaves >> 1, first) > frequent
        of = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(anchor)]))
        own = np.flatnonzero(shared[of])
        own = own[np.r_[True, (anchor[own][1:] != anchor[own][:-1]) | (block[own][1:] != block[own][:-1])]] if len(own) else own
        return pa.RecordBatch.from_arrays([pa.array(block[own]), pa.array(anchor[own]), pa.array(often[of[own]])], names=["block", "anchor", "frequent"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64) for _ in range(4)]
        for batch in batches:
            held = [np.r_[h, batch.column(k).to_numpy()] for k, h in enumerate(held)]
            change = np.flatnonzero(held[0][1:] != held[0][:-1])
            if len(change):
                at = int(change[-1]) + 1
                yield told(*(h[:at] for h in held))
                held = [h[at:] for h in held]
            elif len(held[0]) > 1_000_000:  # one anchor: a row for each block is enough
                anchor, block, low, leaves = held
                _, first = np.unique(block, return_index=True)
                kept = np.zeros(len(first), np.int64)
                kept[0] = 2 * (leaves >> 1).sum() + max(int((leaves & 1).max()), int(low.min() < low.max()))
                held = [anchor[first], block[first], np.full(len(first), low.min()), kept]
        if len(held[0]):
            yield told(*held)
        common.release()

    return run


def _ranges(block: np.ndarray, row: np.ndarray, first: np.ndarray, last: np.ndarray) -> pa.RecordBatch:
    """Lost word ranges, those that touch merged."""
    order = np.lexsort((first, row, block))
    block, row, first, last = block[order], row[order], first[order], last[order]
    if len(row):
        # ends never shrink within a row: all that are merged come from leaves in order
        new = np.r_[True, (row[1:] != row[:-1]) | (block[1:] != block[:-1]) | (first[1:] > last[:-1])]
        at = np.flatnonzero(new)
        block, row, first, last = block[at], row[at], first[at], np.maximum.reduceat(last, at)
    return pa.RecordBatch.from_arrays([pa.array(block), pa.array(row), pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32))], names=["block", "row", "first", "last"])


LEAF = "route long, block long, row long, doc_id long, first int, last int, words binary"
LEAF_NAMES = [x.split()[0] for x in LEAF.split(", ")]


def _leaves(window: int, gram: int, uri: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at_block, shared, often = None, np.zeros(0, np.uint64), np.zeros(0, bool)
        sent: dict[int, tuple[bytes, int]] = {}  # digest of a leaf -> its text and the smallest document sent
        for block, table in common.block_runs(batches, BLOCK_BYTES):
            if block != at_block:
                found = [(b.column(0).to_numpy(), b.column(1).to_numpy(zero_copy_only=False)) for b in common.read_block(uri, block, ["anchor", "frequent"])]
                at_block, shared, often = block, np.zeros(0, np.uint64), np.zeros(0, bool)
                if found:
                    shared = np.concatenate([x for x, _ in found]).view(np.uint64)
                    order = np.argsort(shared)
                    shared, often = shared[order], np.concatenate([x for _, x in found])[order]
            if not len(shared):
                continue
            leaves = Leaves(common.array(table, 0), window, gram)
            where = np.minimum(np.searchsorted(shared, leaves.anchor), len(shared) - 1)
            keep = np.flatnonzero(shared[where] == leaves.anchor)
            if not len(keep):
                continue
            at, n, text, first, anchor, frequent = leaves.at[keep], leaves.n[keep], leaves.text[keep], leaves.first[keep], leaves.anchor[keep], often[where[keep]]
            if frequent.any():  # the prefix grows to the whole window
                times = np.where(frequent, n, 1)
                own = np.repeat(np.arange(len(n)), times)
                step = np.where(frequent[own], np.arange(len(own)) - np.repeat(np.cumsum(times) - times, times), 0)
                at, first, n, text, anchor, frequent = at[own] + step, first[own] + step, np.where(frequent[own], 1, n[own]), text[own], anchor[own], frequent[own]
            rows, doc_ids = table.column(2).to_numpy()[text], table.column(3).to_numpy()[text]
            begin, end, data = leaves.words.first[at], leaves.words.last[at + n + window - 2], leaves.words.data
            digest = mix(leaves.windows[at] + mix(leaves.windows[at + n - 1] ^ n.astype(np.uint64)))
            order = np.lexsort((doc_ids, digest))
            same = np.r_[False, digest[order][1:] == digest[order][:-1]]
            heads = order[np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))]
            lost = np.zeros(len(at), bool)
            cut = lambda k: data[begin[k] : end[k]].tobytes()  # noqa: B023, E731
            repeated = np.flatnonzero(same & (doc_ids[order] > doc_ids[heads]))
            head, body = -1, b""
            for k, h in zip(order[repeated].tolist(), heads[repeated].tolist(), strict=True):
                if h != head:
                    head, body = h, cut(h)
                    if len(sent) < SENT_LEAVES or int(digest[h]) in sent:
                        before = sent.get(int(digest[h]))
                        if before is None or before[0] == body and before[1] > doc_ids[h]:
                            sent[int(digest[h])] = (body, int(doc_ids[h]))
                lost[k] = cut(k) == body
            if sent:
                known = np.fromiter(sent, np.uint64, len(sent))
                for k in np.flatnonzero(~lost & np.isin(digest, known)).tolist():
                    body, least = sent[int(digest[k])]
                    lost[k] = doc_ids[k] > least and cut(k) == body
            last = first + n + window - 1
            if lost.any():
                found = _ranges(np.full(int(lost.sum()), block), rows[lost], first[lost], last[lost])
                m = found.num_rows
                yield pa.RecordBatch.from_arrays([pa.array(mix(found.column(1).to_numpy().astype(np.uint64)).view(np.int64)), found.column(0), found.column(1), pa.array(np.zeros(m, np.int64)), found.column(2), found.column(3), pa.array([None] * m, pa.binary())], names=LEAF_NAMES)
            route = np.where(frequent, mix(leaves.windows[at] ^ A), anchor).view(np.int64)
            left = np.flatnonzero(~lost)
            for k in range(0, len(left), 20_000):
                s = left[k : k + 20_000]
                yield pa.RecordBatch.from_arrays([pa.array(route[s]), pa.array(np.full(len(s), block)), pa.array(rows[s]), pa.array(doc_ids[s]), pa.array(first[s].astype(np.int32)), pa.array(last[s].astype(np.int32)), slices(data, begin[s], end[s])], names=LEAF_NAMES)

    return run


def sorted_suffixes(codes: np.ndarray, starts: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(order of the suffixes at ``starts`` by their first ``depth`` codes, length of each one's common prefix with the one before, up to ``depth``).

    Every start has ``depth`` codes. Runs of 1, 2, 4, ... codes get names that keep their order.
    """
    names, span = [(1, np.unique(codes, return_inverse=True)[1])], 1
    while span < depth:
        step = min(span, depth - span)
        one = names[-1][1].astype(np.uint64)
        two = np.zeros(len(one), np.uint64)
        two[: len(one) - step] = one[step:]
        names.append((span + step, np.unique((one << np.uint64(32)) | two, return_inverse=True)[1]))
        span += step
    order = np.argsort(names[-1][1][starts], kind="stable")
    common_ = np.zeros(len(order), np.int64)
    if len(order) > 1:
        whole = names[-1][1][starts[order]]
        common_[1:] = np.where(whole[1:] == whole[:-1], depth, 0)
        unlike = np.flatnonzero(common_[1:] == 0) + 1
        one, two, found = starts[order][unlike], starts[order][unlike - 1], np.zeros(len(unlike), np.int64)
        for size, name in reversed(names[:-1]):
            end = len(name) - 1
            equal = (found + size <= depth) & (name[np.minimum(one + found, end)] == name[np.minimum(two + found, end)])
            found += np.where(equal, size, 0)
        common_[unlike] = np.minimum(found, depth - 1)
    return order, common_


def _subtrees(window: int):
    """Leaves sorted by route and document to the ranges that are lost."""

    def solve(part: pa.Table) -> tuple[pa.RecordBatch | None, np.ndarray]:
        """(lost ranges, rows some of whose suffixes are kept) of whole groups, or of what has come of a single one."""
        block, row, doc_id, first = (part.column(k).to_numpy() for k in ("block", "row", "doc_id", "first"))
        words = Words(common.array(part, "words"))
        of, codes = words.doc, words.distinct()[1]
        starts = np.flatnonzero(np.arange(len(of)) + window <= (words.begin + words.sizes)[of])
        order, shared = sorted_suffixes(codes, starts, window)
        starts = starts[order]
        node = np.cumsum(shared < window)
        leaf = of[starts]
        by = np.lexsort((doc_id[leaf], node))
        starts, leaf, node = starts[by], leaf[by], node[by]
        head = np.r_[True, node[1:] != node[:-1]]
        least = doc_id[leaf][np.flatnonzero(head)][np.cumsum(head) - 1]
        lost = doc_id[leaf] > least
        kept = np.unique(leaf[~lost])
        if not lost.any():
            return None, kept
        leaf, at = leaf[lost], (starts - words.begin[leaf])[lost] + first[leaf[lost]]
        return _ranges(block[leaf], row[leaf], at, at + window), kept

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            done = batch.column(6).is_null()
            if done.true_count:
                own = batch.filter(done)
                yield pa.RecordBatch.from_arrays([own.column(k) for k in (1, 2, 4, 5)], names=["block", "row", "first", "last"])
                batch = batch.filter(pa.compute.invert(done))
            for at in range(0, batch.num_rows, GROUP_ROWS):
                part = batch.slice(at, GROUP_ROWS)
                held.append(part)
                size += part.num_rows
                if size < GROUP_ROWS:
                    continue
                whole = pa.Table.from_batches(held)
                route = whole.column("route").to_numpy()
                change = np.flatnonzero(route[1:] != route[:-1])
                if len(change):  # cut at the last change, so that no group is divided
                    end = int(change[-1]) + 1
                    found, _ = solve(whole.slice(0, end))
                    whole = whole.slice(end)
                else:  # documents ascend: later rows of the group need only those that keep something
                    found, kept = solve(whole)
                    whole = whole.take(pa.array(kept))
                if found is not None:
                    yield found
                held, size = whole.combine_chunks().to_batches(), whole.num_rows
        if size:
            found, _ = solve(pa.Table.from_batches(held))
            if found is not None:
                yield found
        common.release()

    return run


def _cut(window: int, uri: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at_block, lost = None, np.zeros((0, 3), np.int64)
        for block, table in common.block_runs(batches, BLOCK_BYTES):
            if block != at_block:
                found = [np.c_[b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_numpy()] for b in common.read_block(uri, block, ["row", "first", "last"])]
                at_block, lost = block, np.concatenate(found) if found else np.zeros((0, 3), np.int64)
                lost = lost[np.argsort(lost[:, 0], kind="stable")]
            words = Words(common.array(table, 0))
            row = table.column(2).to_numpy()
            a, b = np.searchsorted(lost[:, 0], row), np.searchsorted(lost[:, 0], row, side="right")
            text = np.repeat(np.arange(len(row)), b - a)
            own = lost[np.arange(len(text)) + np.repeat(a - np.r_[0, np.cumsum(b - a)[:-1]], b - a)]
            edge = np.zeros(len(words) + 1, np.int64)
            np.add.at(edge, words.begin[text] + own[:, 1], 1)
            np.add.at(edge, words.begin[text] + own[:, 2], -1)
            keep = np.cumsum(edge[:-1]) == 0
            # kept words, each with a space after it
            first, last, data = words.first[keep], words.last[keep], words.data
            sizes = last - first + 1
            ends = np.r_[0, np.cumsum(sizes)]
            pick = np.minimum(np.arange(int(ends[-1])) + np.repeat(first - ends[:-1], sizes), max(0, len(data) - 1))
            body = data[pick]
            body[ends[1:] - 1] = 32
            body = body.tobytes()
            n_kept = np.r_[0, np.cumsum(keep)]
            cuts = n_kept[np.r_[words.begin, len(words)]]
            kept = [body[x : max(x, y - 1)] for x, y in zip(ends[cuts[:-1]].tolist(), ends[cuts[1:]].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([common.array(table, 3), pa.array(words.sizes.astype(np.int64)), pa.array(words.sizes - np.diff(cuts)), pa.array(kept, pa.binary())], names=["doc_id", "n_words", "n_removed", "kept"])

    return run


def repeated_ranges(rows: DataFrame, window: int = WINDOW, gram: int = GRAM, frequent: int = FREQUENT) -> DataFrame:
    """block, row, first, last: word ranges (end exclusive) of ``common.located`` rows covered by windows that also start in a smaller document."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.where("doc_id is not null")
    seen = rows.mapInArrow(_count_anchors(window, gram), "anchor long, block long, low long, leaves long")
    seen = seen.repartition(n, "anchor").sortWithinPartitions("anchor")
    uri = common.write_blocks(seen.mapInArrow(_shared_anchors(frequent), "block long, anchor long, frequent boolean"))
    leaves = rows.mapInArrow(_leaves(window, gram, uri), LEAF)
    groups = leaves.repartition(n, "route").sortWithinPartitions("route", "doc_id")
    return groups.mapInArrow(_subtrees(window), "block long, row long, first int, last int")


def maximal_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, frequent: int = FREQUENT) -> DataFrame:
    """doc_id, first, last: the longest word ranges of each document whose every window also starts in a smaller document.

    Rows of a repeated doc_id have ranges of their own each; rows with a null doc_id have none.
    """
    rows = common.located(docs)
    lost = common.materialize(repeated_ranges(rows, window, gram, frequent))
    ids = rows.select("block", "row", "doc_id")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, end = None, None
        out: list[tuple[int, int, int]] = []
        for batch in batches:
            for block, row, doc_id, first, last in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if at is not None and at[:2] == (block, row) and first <= end - window + 1:  # the next window is a repeat too
                    end = max(end, last)
                    continue
                if at is not None:
                    out.append((at[2], at[3], end))
                at, end = (block, row, doc_id, first), last
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], kind) for k, kind in enumerate((pa.int64(), pa.int32(), pa.int32()))], names=["doc_id", "first", "last"])
            out = []
        if at is not None:
            yield pa.RecordBatch.from_arrays([pa.array([at[2]], pa.int64()), pa.array([at[3]], pa.int32()), pa.array([end], pa.int32())], names=["doc_id", "first", "last"])

    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = lost.join(ids, ["block", "row"]).select("block", "row", "doc_id", "first", "last")
    return found.repartition(n, "block", "row").sortWithinPartitions("block", "row", "first").mapInArrow(merge, "doc_id long, first int, last int")


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, frequent: int = FREQUENT) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_text (the kept words joined by one space).

    Words are [^\\x20\\x09-\\x0D]+, unchanged; a null text has none. A text shorter than the window loses nothing. Rows
    that repeat a doc_id are one document to each other: they don't remove each other's words. Rows with a null
    doc_id take no part and are kept whole. Other columns are ignored, an empty table gives an empty result. Passages
    are compared word by word; digests only decide which of them meet.
    """
    rows = common.located(docs)
    uri = common.write_blocks(repeated_ranges(rows, window, gram, frequent))
    cut = rows.mapInArrow(_cut(window, uri), "doc_id long, n_words long, n_removed long, kept binary")
    return cut.select("doc_id", "n_words", "n_removed", F.col("kept").cast("string").alias("kept_text"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(common.table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM d WHERE len(ws) >= 13)),
first AS (SELECT k, min(doc_id) AS low FROM win GROUP BY k),
lost AS (SELECT DISTINCT doc_id, i + j AS place FROM win JOIN first USING (k) CROSS JOIN range(13) t(j) WHERE low < doc_id),
words AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS place FROM d),
kept AS (SELECT words.doc_id, string_agg(word, ' ' ORDER BY words.place) AS body, count(*) AS n FROM words LEFT JOIN lost ON lost.doc_id = words.doc_id AND lost.place = words.place WHERE lost.place IS NULL GROUP BY words.doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(body, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
"""
