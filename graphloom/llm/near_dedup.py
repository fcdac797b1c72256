"""MinHash near-duplicate detection with sequential Bayesian verification.

1. One pass over the texts gives each document its set of word shingles as 64-bit digests, the set's size, a digest
   of the whole set (128 bits) and a signature of minima. Documents with equal sets form a class; only classes go on.
2. Bands of the signature put classes into buckets. Buckets with the same members are one bucket.
3. Within a bucket, signatures are compared batch by batch. After m matches among n hashes, the posterior of the
   similarity under a uniform prior is Beta(m + 1, n - m + 1); a pair goes when its chance to reach the threshold
   falls below the miss probability. Pairs aren't listed: a class that already hangs together with another isn't
   compared with it again, so a bucket gives a spanning set of survivors.
4. Survivors are verified on the full sets. Where one fails, the bucket is gone through again with the verified
   components and the full sets at hand, and every survivor between components still apart is verified on the spot, so
   no link is lost to the shortcut in 3 and only links leave the bucket.
5. Links give components; documents get them back through their class.

Buckets above ``block`` members are dealt over several tasks, each with the same pivots; what the pivots leave in
other components is then compared, as a query set, against all blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .components import connected_components
from .words import A, B, Words, mix

BANDS, ROWS = 32, 4
HASHES = BANDS * ROWS
BATCH = 32
MISS = 1e-5
BLOCK = 2048
#: Bytes of text whose sets are made at once, and of texts whose full sets are.
BLOCK_BYTES = 4 << 20
#: Slots of the bitmap that names the documents to be verified: 2 MB, whatever the input.
SLOT_BITS = 24
SALT_PAIRS = 500


def least_matches(threshold: float, miss: float = MISS, hashes: int = HASHES, batch: int = BATCH) -> list[tuple[int, int]]:
    """(n, m): after n hashes a pair with fewer than m matches is pruned.

    P(J >= t | m of n) for the uniform prior equals P(Binomial(n + 1, t) <= m).
    """
    out = []
    for n in range(batch, hashes + 1, batch):
        total, m = 0.0, 0
        while True:
            total += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if total >= miss:
                break
            m += 1
        out.append((n, m))
    return out


def shingle_sets(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(digests, ends): the sorted distinct digests of each text's ``size``-word shingles, one text after the other.

    A-Z count as a-z; fewer words are one shingle.
    """
    words = Words(texts)
    h, doc = words.digests(fold=True), words.doc
    out = np.zeros(max(0, len(h) - size + 1), np.uint64)
    for k in range(size):
        out *= A
        out += h[k : k + len(out)]
    at = np.flatnonzero(doc[: len(out)] == doc[size - 1 : size - 1 + len(out)])
    found, of = mix(out[at] + np.uint64(size)), doc[at]
    for n in range(1, size):
        few = np.flatnonzero(words.sizes == n)
        if len(few):
            one = np.zeros(len(few), np.uint64)
            for k in range(n):
                one = one * A + h[words.begin[few] + k]
            found, of = np.r_[found, mix(one + np.uint64(n))], np.r_[of, few]
    if (of[1:] < of[:-1]).any():
        order = np.argsort(of, kind="stable")
        found, of = found[order], of[order]
    cuts = np.searchsorted(of, np.arange(len(words.sizes) + 1)).tolist()
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        found[a:b].sort()
    new = np.ones(len(found), bool)
    new[1:] = (found[1:] != found[:-1]) | (of[1:] != of[:-1])
    return found[new], np.searchsorted(of[new], np.arange(len(words.sizes) + 1))


def class_digests(x: np.ndarray, ends: np.ndarray) -> pa.Array:
    """128 bits for each set that isn't empty: two sums of unlike mixes of its digests, and its size."""
    if len(ends) < 2:
        return pa.array([], pa.binary())
    first, n = ends[:-1], np.diff(ends).astype(np.uint64)
    one, two = (np.add.reduceat(mix(x ^ k), first) for k in (A, B))
    both = np.c_[mix(one + n * B), mix(two * A + n)].astype("<u8")
    return pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer((16 * np.arange(len(n) + 1)).astype(np.int32).tobytes()), pa.py_buffer(both.tobytes())])


def signatures(x: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """16 bits of each of HASHES minima, for sets that aren't empty."""
    rng = np.random.default_rng(20_011)
    a = rng.integers(0, 1 << 63, HASHES, np.uint64) * np.uint64(2) + np.uint64(1)
    b = rng.integers(0, 1 << 63, HASHES, np.uint64)
    n = len(ends) - 1
    out = np.empty((n, HASHES), np.uint16)
    at = 0
    while at < n:  # small pieces stay in cache
        end = max(at + 1, int(np.searchsorted(ends, ends[at] + 32_768, side="right")) - 1)
        own, first = x[ends[at] : ends[end]], ends[at:end] - ends[at]
        held = np.empty_like(own)
        for k in range(HASHES):
            np.multiply(own, a[k], out=held)
            held += b[k]
            out[at:end, k] = np.minimum.reduceat(held, first) >> np.uint64(40) & np.uint64(0xFFFF)
        at = end
    return out


def _prints(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in common.chunks(batches, "text", BLOCK_BYTES):
            x, ends = shingle_sets(part.column("text").combine_chunks(), size)
            n = np.diff(ends)
            full = np.flatnonzero(n)
            sets = np.r_[ends[:-1][full], ends[-1]]
            sig = signatures(x, sets).astype("<u2")
            at = np.full(len(n), -1)
            at[full] = np.arange(len(full))
            take = pa.array(at, mask=at < 0)
            blobs = pa.Array.from_buffers(pa.binary(), len(full), [None, pa.py_buffer((2 * HASHES * np.arange(len(full) + 1)).astype(np.int32).tobytes()), pa.py_buffer(sig.tobytes())])
            yield pa.RecordBatch.from_arrays([part.column("doc_id").combine_chunks(), pa.array(n.astype(np.int64)), class_digests(x, sets).take(take), blobs.take(take)], names=["doc_id", "n_shingles", "digest", "sig"])

    return run


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        cid = batch.column(0).to_numpy()
        sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint64).reshape(len(cid), BANDS)
        key = mix(sig + np.arange(1, BANDS + 1, dtype=np.uint64) * B)
        yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), pa.array(np.repeat(cid, BANDS))], names=["key", "cid"])


def _shared_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key without those whose key is alone."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        key, cid = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        if held is not None:
            key, cid = np.r_[held[0], key], np.r_[held[1], cid]
        same = key[1:] == key[:-1]
        shared = np.r_[False, same] | np.r_[same, False]
        if held is not None and held[2]:
            shared[0] = True
        out = np.flatnonzero(shared[:-1])  # the last row waits for what follows
        held = (key[-1:], cid[-1:], bool(shared[-1]))
        yield pa.RecordBatch.from_arrays([pa.array(key[out]), pa.array(cid[out])], names=["key", "cid"])
    if held is not None and held[2]:
        yield pa.RecordBatch.from_arrays([pa.array(held[0]), pa.array(held[1])], names=["key", "cid"])


def _survivors(one: np.ndarray, many: np.ndarray, least: list[tuple[int, int]]) -> np.ndarray:
    """Rows of ``many`` that the posterior doesn't prune against ``one``, batch after batch."""
    left = np.arange(len(many))
    matches = np.zeros(len(many), np.int32)
    at = 0
    for n, m in least:
        matches = matches + (many[left, at:n] == one[at:n]).sum(1, dtype=np.int32)
        keep = matches >= m
        left, matches, at = left[keep], matches[keep], n
        if not len(left):
            break
    return left


def spanning_candidates(sig: np.ndarray, least: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Pairs of rows that connect what survives, without pairs inside what is already connected."""
    n = len(sig)
    label, pairs = np.arange(n), []

    def reach(i: int) -> None:
        others = np.flatnonzero(label != label[i])
        if len(others):
            for j in others[_survivors(sig[i], sig[others], least)].tolist():
                if label[j] != label[i]:
                    pairs.append((i, j))
                    label[label == label[j]] = label[i]

    waiting = []
    for i in range(n):
        if label[i] == i and not (i and (label[:i] == i).any()):
            reach(i)
        else:
            waiting.append(i)
    values, sizes = np.unique(label, return_counts=True)
    largest = label == values[sizes.argmax()] if n else label  # as it is now: its rows are met from the other side, whatever merges later
    for i in waiting:
        if (label == label[0]).all():
            break
        if not largest[i]:
            reach(i)
    return pairs


def settle(sig: np.ndarray, sets: list[np.ndarray], label: np.ndarray, least: list[tuple[int, int]], percent: int) -> list[tuple[int, int]]:
    """Verified links that connect the components of a bucket: every survivor between components still apart is verified here."""
    label, pairs = label.copy(), []
    values, sizes = np.unique(label, return_counts=True)
    largest = values[sizes.argmax()]
    for i in np.flatnonzero(label != largest).tolist():
        others = np.flatnonzero(label != label[i])
        if not len(others):
            break
        others = others[_survivors(sig[i], sig[others], least)]
        for at in range(0, len(others), 256):
            own = others[at : at + 256]
            own = own[label[own] != label[i]]
            if not len(own):
                continue
            found = np.concatenate([sets[j] for j in own.tolist()])
            sizes_ = np.array([len(sets[j]) for j in own.tolist()])
            k = np.minimum(np.searchsorted(sets[i], found), len(sets[i]) - 1)
            both = np.add.reduceat((sets[i][k] == found).astype(np.int64), np.cumsum(sizes_) - sizes_)
            for j in own[100 * both >= percent * (len(sets[i]) + sizes_ - both)].tolist():
                if label[j] != label[i]:
                    pairs.append((i, j))
                    label[label == label[j]] = label[i]
    return pairs


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Whole groups of rows that arrive sorted by the keys."""
    held = []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(batch.schema.get_field_index(k)).to_numpy() for k in keys]
        if held and any(held[-1].column(held[-1].schema.get_field_index(k))[-1].as_py() != c[0] for k, c in zip(keys, columns, strict=True)):
            yield pa.Table.from_batches(held)
            held = []
        change = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in columns])) + 1
        cuts = [0, *change.tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            held.append(batch.slice(a, b - a))
            if b < batch.num_rows:
                yield pa.Table.from_batches(held)
                held = []
    if held:
        yield pa.Table.from_batches(held)


def _compare(least: list[tuple[int, int]], percent: int | None = None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, a, b = [], [], []

        def out():
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["key", "a", "b"])

        for group in _groups(batches, ["key", "blk"]):
            cid = group.column("cid").to_numpy()
            _, once = np.unique(cid, return_index=True)
            if len(once) < 2:
                continue
            cid = cid[once]
            blobs = group.column("sig").to_pylist()
            sig = np.frombuffer(b"".join([blobs[k] for k in once.tolist()]), np.uint16).reshape(len(once), HASHES)
            if percent is None:
                pairs = spanning_candidates(sig, least)
            else:
                sets = group.column("set").to_pylist()
                pairs = settle(sig, [np.frombuffer(sets[k], np.uint64) for k in once.tolist()], group.column("label").to_numpy()[once], least, percent)
            key = group.column("key")[0].as_py()
            for i, j in pairs:
                x, y = int(cid[i]), int(cid[j])
                keys.append(key), a.append(min(x, y)), b.append(max(x, y))
            if len(keys) > 20_000:
                yield out()
                keys, a, b = [], [], []
        yield out()

    return run


def _full_sets(size: int, held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(held.value, np.uint8)

        def wanted():
            for batch in batches:
                slot = batch.column(0).to_numpy()
                keep = (bits[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8)) & 1 == 1
                if keep.any():
                    yield batch.filter(pa.array(keep))

        for part in common.chunks(wanted(), "text", BLOCK_BYTES):
            x, ends = shingle_sets(part.column("text").combine_chunks(), size)
            full = np.flatnonzero(np.diff(ends))
            ends = np.r_[ends[:-1][full], ends[-1]]
            digests, data = class_digests(x, ends), x.astype("<u8").tobytes()
            for at in range(0, len(full), 500):
                cuts = ends[at : min(at + 500, len(full)) + 1]
                blobs = pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer((8 * (cuts - cuts[0])).astype(np.int32).tobytes()), pa.py_buffer(data[8 * int(cuts[0]) : 8 * int(cuts[-1])])])
                yield pa.RecordBatch.from_arrays([digests.slice(at, len(cuts) - 1), blobs], names=["digest", "set"])

    return run


def _verify(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, base = None, None
        for batch in batches:
            a, b, ok = [], [], []
            for key, salt, cid, data in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                own = np.frombuffer(data, np.uint64)
                if cid == key:
                    at, base = (key, salt), own
                    continue
                if at != (key, salt):
                    raise ValueError("a pair's first set is missing")
                k = np.searchsorted(base, own)
                both = int((base[np.minimum(k, len(base) - 1)] == own).sum())
                a.append(key), b.append(cid), ok.append(100 * both >= percent * (len(base) + len(own) - both))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(ok, pa.bool_())], names=["a", "b", "linked"])

    return run


def _sets_of(docs: DataFrame, classes: DataFrame, cids: DataFrame, size: int) -> DataFrame:
    """set_of, set: the full sets of the classes named, by another pass over the texts."""
    named = classes.join(cids, "cid", "left_semi").select("digest", "first", F.col("cid").alias("set_of"))
    held = common.slot_bitmap(named.select("first"), "first", SLOT_BITS)
    texts = docs.select(common.slot("doc_id", SLOT_BITS).alias("slot"), F.col("text").cast("binary").alias("text"))
    sets = texts.mapInArrow(_full_sets(size, held), "digest binary, set binary")
    # equal sets of several documents are one row
    return sets.join(named.select("digest", "set_of"), "digest").select("set_of", "set").dropDuplicates(["set_of"])


def _verified(docs: DataFrame, classes: DataFrame, pairs: DataFrame, size: int, percent: int) -> DataFrame:
    """pairs (a, b) with ``linked``, by their full sets: each pair's sets meet once, a frequent first set is salted."""
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    per = pairs.groupBy("a").agg(F.count("*").alias("n"))
    salted = pairs.join(per, "a").select("a", "b", F.expr(f"cast(pmod(xxhash64(b), 1 + n div {SALT_PAIRS}) as int)").alias("salt"))
    uses = salted.select("a", "salt", F.col("b").alias("cid")).unionByName(salted.select("a", "salt", F.col("a").alias("cid")).distinct())
    uses = common.materialize(uses)
    sets = _sets_of(docs, classes, uses.select("cid").distinct(), size)
    met = uses.join(sets, uses.cid == sets.set_of).select("a", "salt", "cid", "set", (F.col("cid") != F.col("a")).alias("second"))
    dealt = met.repartition(n, "a", "salt").sortWithinPartitions("a", "salt", "second").select("a", "salt", "cid", "set")
    return common.materialize(dealt.mapInArrow(_verify(percent), "a long, b long, linked boolean"))


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, miss: float = MISS, block: int = BLOCK) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept, class_id.

    Words are [^\\x20\\x09-\\x0D]+ with A-Z lower-cased. A document's set holds its distinct ``shingle``-word shingles;
    with fewer words the whole sequence is one shingle. Documents link when 100 * |intersection| >= percent * |union|;
    component_id is the smallest doc_id of the linked component, kept marks that document. Empty and null texts have
    no set, link with nothing and are kept. Rows that repeat a doc_id are nodes of their own; all rows with the
    smallest id are marked kept. Null doc_ids take part but never name a component that has an id; a component of
    null ids has a null component_id and is kept. Other columns are ignored, an empty table gives an empty result.
    class_id is common to documents with equal sets, by 128 bits of the set. A linked pair is missed with a chance below 1e-4 (bands and
    pruning); no unlinked pair is linked.
    """
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = common.documents(docs)
    bytes_ = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    prints = common.materialize(bytes_.mapInArrow(_prints(shingle), "doc_id long, n_shingles long, digest binary, sig binary"))
    classes = prints.where("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("first"), F.min("sig").alias("sig"))
    classes = common.materialize(classes.withColumn("cid", F.monotonically_increasing_id()))  # written, so the numbers stay
    keyed = classes.select("cid", "sig").mapInArrow(_bands, "key long, cid long").repartition(n, "key").sortWithinPartitions("key")
    members = common.materialize(keyed.mapInArrow(_shared_keys, "key long, cid long"))
    sizes = members.groupBy("key").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("cid")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "cid")).alias("y"), F.min("cid").alias("pivot"), F.max("cid").alias("pivot2"))
    sizes = sizes.groupBy("n", "x", "y").agg(F.min(F.struct("key", "pivot", "pivot2")).alias("k")).select("n", "k.*")
    members = members.join(sizes, "key").withColumn("blocks", F.expr(f"1 + (n - 1) div {block}"))
    members = common.materialize(members.withColumn("blk", F.expr("cast(pmod(xxhash64(cid), blocks) as int)")).select("key", "cid", "n", "blocks", "blk", "pivot", "pivot2"))
    hot = members.where("blocks > 1").groupBy("key", "blocks").agg(F.min("pivot").alias("pivot"), F.min("pivot2").alias("pivot2"))
    pivots = hot.select("key", F.explode(F.array("pivot", "pivot2")).alias("cid"), "blocks").select("key", "cid", F.explode(F.expr("sequence(0, cast(blocks as int) - 1)")).alias("blk"))
    least = least_matches(percent / 100, miss)
    sigs = classes.select(F.col("cid").alias("of"), "sig")

    dealt = members.select("key", "cid", "blk").unionByName(pivots).join(sigs, F.col("cid") == F.col("of")).select("key", "blk", "cid", "sig")
    dealt = dealt.repartition(n, "key", "blk").sortWithinPartitions("key", "blk")
    found = common.materialize(dealt.mapInArrow(_compare(least), "key long, a long, b long"))
    verified = _verified(docs, classes, found.select("a", "b").distinct(), shingle, percent)
    links = verified.where("linked").select("a", "b")
    labels = connected_components(links)

    # buckets to go through again: a survivor failed there, or the bucket was dealt over several blocks
    again = found.join(verified.where("not linked"), ["a", "b"], "left_semi").select("key").unionByName(hot.select("key")).distinct()
    named = members.join(again, "key", "left_semi").join(labels, F.col("cid") == F.col("node"), "left").select("key", "cid", "n", "blocks", "blk", F.coalesce("label", "cid").alias("label"))
    named = common.materialize(named)
    counts = named.groupBy("key", "label").agg(F.count("*").alias("of_label"))
    main = counts.groupBy("key").agg(F.max(F.struct("of_label", "label")).alias("m"), F.count("*").alias("labels")).where("labels > 1").select("key", F.col("m.label").alias("main"))
    named = named.join(main, "key")
    query = named.where("blocks > 1 and label <> main").select("key", "cid", "label", F.explode(F.expr("sequence(0, cast(blocks as int) - 1)")).alias("blk"))
    rest = common.materialize(named.select("key", "cid", "label", "blk").unionByName(query))
    if rest.limit(1).count():
        sets = _sets_of(docs, classes, rest.select("cid").distinct(), shingle)
        full = sets.join(sigs, F.col("set_of") == F.col("of")).select("of", "sig", "set")
        dealt = rest.join(full, F.col("cid") == F.col("of")).select("key", "blk", "cid", "label", "sig", "set")
        dealt = dealt.repartition(n, "key", "blk").sortWithinPartitions("key", "blk")
        more = common.materialize(dealt.mapInArrow(_compare(least, percent), "key long, a long, b long")).select("a", "b").distinct()
        labels = connected_components(links.unionByName(more))

    nodes = classes.select("cid", "first", "digest").join(labels, F.col("cid") == F.col("node"), "left").select("digest", "first", F.coalesce("label", "cid").alias("label"))
    least_of = nodes.groupBy("label").agg(F.min("first").alias("component"))
    nodes = nodes.join(least_of, "label").select(F.col("digest").alias("of"), "component")
    out = prints.select("doc_id", "n_shingles", "digest").join(nodes, F.col("digest") == F.col("of"), "left")
    component = F.when(F.col("of").isNull(), F.col("doc_id")).otherwise(F.col("component"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), F.hex("digest").alias("class_id"))


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.table(spark, sf_dir, "documents"), shingle=2)
