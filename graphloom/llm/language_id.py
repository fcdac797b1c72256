"""Language identification by mixture inference.

Every language has a table of smoothed log probabilities of byte trigrams, hashed into a fixed number of slots, from
the trigram counts of all its training documents. A document is a bag of words, each with a likelihood under each
language (the product over its trigrams). Expectation-maximisation estimates the proportions of the languages; the set
of languages is chosen by likelihood less a penalty for each language: from the best single one on, the language that
adds most joins as long as that pays. All documents of a block are estimated at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SLOTS = 1 << 17
SMOOTHING = 0.1
ROUNDS = 12
UNKNOWN = "und"
#: Bytes of text that a kernel handles at once.
BLOCK_BYTES = 2 << 20


def _byte_classes() -> np.ndarray:
    """Lower-cased letter byte, or 0 for bytes that separate words."""
    lut = np.zeros(256, np.uint8)
    lut[128:] = np.arange(128, 256)
    lut[97:123] = np.arange(97, 123)
    lut[65:91] = np.arange(97, 123)
    return lut


def _slots(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Trigram slot at each byte, which bytes are letters, and which begin a word."""
    code = _byte_classes()[data].astype(np.uint32)
    letter = code > 0
    before = np.empty_like(code)
    before[:1], before[1:] = 0, code[:-1]
    after = np.empty_like(code)
    after[-1:], after[:-1] = 0, code[1:]
    gram = (before << np.uint32(16)) | (code << np.uint32(8)) | after
    mixed = gram * np.uint32(2654435761)
    slot = (mixed ^ (mixed >> np.uint32(15))) & np.uint32(SLOTS - 1)
    return slot, letter, letter & (before == 0)


def _pieces(texts: list[bytes]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last, bytes, offsets) of runs of texts of about BLOCK_BYTES, a zero byte between texts."""
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) <= BLOCK_BYTES):
            size += len(texts[end]) + 1
            end += 1
        offsets = np.cumsum([0, *(len(t) + 1 for t in texts[at:end])])
        yield at, end, np.frombuffer(b"\0".join(texts[at:end]) + b"\0", np.uint8), offsets
        at = end


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, np.ndarray] = {}
    for batch in batches:
        langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for lang in set(langs):
            own = counts.setdefault(lang, np.zeros(SLOTS, np.int64))
            for _, _, data, _ in _pieces([t for t, of in zip(texts, langs, strict=True) if of == lang]):
                slot, letter, _ = _slots(data)
                own += np.bincount(slot[letter], minlength=SLOTS)
    for lang, own in counts.items():
        at = np.flatnonzero(own)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(own[at], pa.int64())], names=["lang", "slot", "n"])


def train(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """(languages, log probabilities [SLOTS, languages]) from text and non-null lang of the documents outside the held-out third.

    All these documents count. What reaches the driver is bounded: at most SLOTS rows for each language.
    """
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~common.is_held_out(F.col("doc_id")))
    rows = known.select(F.col("lang").cast("string"), F.col("text").cast("string").cast("binary").alias("text")).mapInArrow(_count, "lang string, slot int, n long")
    table = rows.groupBy("lang", "slot").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(set(table.column("lang").to_pylist()))
    counts = np.zeros((SLOTS, len(langs)))
    if langs:
        of = {x: k for k, x in enumerate(langs)}
        counts[table.column("slot").to_numpy(), [of[x] for x in table.column("lang").to_pylist()]] = table.column("n").to_numpy()
    seen = max(1, int((counts.sum(1) > 0).sum()))
    return langs, np.log((counts + SMOOTHING) / (counts.sum(0) + SMOOTHING * seen)).astype(np.float32)


def _proportions(like: np.ndarray, peak: np.ndarray, first: np.ndarray, of: np.ndarray, sizes: np.ndarray, start: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """EM over the words of each document from ``start`` [documents, languages]; proportions and log likelihoods."""
    pi = start
    for _ in range(rounds):
        joint = like * pi[of]
        joint /= np.maximum(joint.sum(1, keepdims=True), 1e-30)
        pi = np.add.reduceat(joint, first, axis=0) / sizes[:, None]
    total = np.log(np.maximum((like * pi[of]).sum(1), 1e-30)) + peak
    return pi, np.add.reduceat(total.astype(np.float64), first)


def _grow_sets(like: np.ndarray, peak: np.ndarray, first: np.ndarray, sizes: np.ndarray, penalty: np.ndarray, rows: np.ndarray, pick: np.ndarray, value: np.ndarray) -> None:
    """Forward selection for the documents ``rows``, whose pick and value hold the best single language; both are updated."""
    k = like.shape[1]
    member = pick[rows] > 0
    while len(rows):
        n = sizes[rows]
        begin = np.r_[0, np.cumsum(n)[:-1]]
        own = np.repeat(first[rows] - begin, n) + np.arange(int(n.sum()))
        of = np.repeat(np.arange(len(rows)), n)
        best, best_pi, best_lang = np.full(len(rows), -np.inf), np.zeros((len(rows), k), np.float32), np.zeros(len(rows), int)
        for lang in range(k):
            start = member.astype(np.float32)
            start[:, lang] = 1.0
            pi, ll = _proportions(like[own], peak[own], begin, of, n, start / start.sum(1, keepdims=True), ROUNDS)
            worth = np.where(member[:, lang], -np.inf, ll - (member.sum(1) + 1) * penalty[rows])
            better = worth > best
            best[better], best_pi[better], best_lang[better] = worth[better], pi[better], lang
        grown = best > value[rows]
        value[rows[grown]], pick[rows[grown]] = best[grown], best_pi[grown]
        member[np.flatnonzero(grown), best_lang[grown]] = True
        grown &= ~member.all(1)
        rows, member = rows[grown], member[grown]


def infer(texts: list[bytes], logp: np.ndarray) -> np.ndarray:
    """Proportions [texts, languages] of the chosen set of languages; all zero where a text has no letter."""
    out = np.zeros((len(texts), logp.shape[1]), np.float32)
    for at, end, data, offsets in _pieces(texts):
        slot, letter, begins = _slots(data)
        where = np.flatnonzero(letter)
        if not len(where):
            continue
        starts = np.flatnonzero(begins[where])
        words = np.add.reduceat(logp[slot[where]], starts, axis=0)
        doc = np.searchsorted(offsets, where[starts], side="right") - 1
        first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
        sizes = np.diff(np.r_[first, len(doc)])
        of = np.repeat(np.arange(len(first)), sizes)
        peak = words.max(1)
        like = np.exp(words - peak[:, None])
        k = logp.shape[1]
        single = np.add.reduceat(words.astype(np.float64), first, axis=0)
        penalty = 0.5 * np.log(sizes + 1.0)
        best = single.argmax(1)
        pick = np.eye(k, dtype=np.float32)[best]
        value = single.max(1) - penalty
        _, ll = _proportions(like, peak, first, of, sizes, np.full((len(first), k), 1.0 / k, np.float32), ROUNDS)
        # no set is likelier than all languages together, and it has two at least
        open_ = np.flatnonzero(ll - 2 * penalty > value)
        if len(open_):
            _grow_sets(like, peak, first, sizes, penalty, open_, pick, value)
        out[at + doc[first]] = pick
    return out


def _small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from batches
    common.release()


def _predict(langs: list[str], logp: np.ndarray, carry: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _small(batches):
            texts = batch.column(1).to_pylist()
            given = [x is not None and any(map(str.isalpha, x)) for x in texts]
            pi = infer([(x or "").encode() for x in texts], logp) if langs else np.zeros((len(texts), 1), np.float32)
            top, share = pi.argmax(1), pi.max(1)
            pred = [(langs[k] if s > 0 else langs[0]) if ok and langs else UNKNOWN for k, s, ok in zip(top.tolist(), share.tolist(), given, strict=True)]
            score = [min(1.0, max(0.0, float(s))) if ok else 0.0 for s, ok in zip(share.tolist(), given, strict=True)]
            own = [batch.column(0), batch.column(2), pa.array(pred, pa.string()), pa.array(score, pa.float64())]
            names = ["doc_id", "held_out", "lang_pred", "score"]
            if carry:
                yield pa.RecordBatch.from_arrays([*own, batch.column(1), *(batch.column(k) for k in (3, 4, 5))], names=[*names, "text", "lang", "source", "n_chars"])
                continue
            mix = [{langs[k]: float(x) for k, x in enumerate(row) if x > 0} if ok and langs else {} for row, ok in zip(pi, given, strict=True)]
            yield pa.RecordBatch.from_arrays([*own, pa.array([list(m.items()) for m in mix], pa.map_(pa.string(), pa.float64()))], names=[*names, "proportions"])

    return run


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray] | None = None, carry: bool = False) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score and the proportions of its languages.

    score is the share of the predicted language. ``und`` with score 0 where the text is null or has no letter, and
    everywhere when there is no training text. Other columns are ignored, an empty table gives an empty result. A null doc_id counts as held out. Repeated rows are judged alike.
    With ``carry`` the columns of documents stay, and the proportions don't.
    """
    common.small_batches(docs.sparkSession)
    langs, logp = model or train(docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), common.is_held_out(F.col("doc_id")).alias("held_out"), *(["lang", "source", "n_chars"] if carry else []))
    out = "doc_id long, held_out boolean, lang_pred string, score double"
    more = "text string, lang string, source string, n_chars long" if carry else "proportions map<string,double>"
    if carry:
        rows = rows.withColumn("lang", F.col("lang").cast("string")).withColumn("source", F.col("source").cast("string")).withColumn("n_chars", F.col("n_chars").cast("long"))
    return rows.mapInArrow(_predict(langs, logp, carry), f"{out}, {more}")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(common.table(spark, sf_dir, "documents")).select("doc_id", "held_out", "lang_pred", "score")
