"""Toxicity scoring: a learned lexicon, Levenshtein automata on its trie, and the context of each hit.

Terms are words far more frequent in toxic than in other labelled texts. A Levenshtein automaton of a text's word,
run along the lexicon's trie, finds terms within one edit, so misspelled terms are hits too. Each hit is weighed in a
window of words around it: quotation marks or reporting words make it a quotation, other hits make it abuse. Sums of
these go through a logistic regression.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .words import Words, buffers_of, string_digests, within_one_deletion

#: Labelled rows that the lexicon and the regression are fitted on: of each label at most.
SAMPLE_PER_LABEL = 10_000
LEXICON_TERMS, MIN_DOCS, MIN_LOG_ODDS = 2000, 3, 2.0
#: Letters of a term at least, and of one that is found with an edit too.
TERM_LENGTH, FUZZY_LENGTH = 3, 5
#: Possible hits that a task remembers.
KNOWN_WORDS = 100_000
#: Bytes of text scored at once.
BLOCK_BYTES = 4 << 20
WINDOW = 5
THRESHOLD = 0.7
FEATURES = 10
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")
_SIGNS = re.compile("[013457@$!]")
_QUOTES = re.compile("[\"“”„«»]")
#: Words that report another's speech.
REPORTING = frozenset("said says wrote quote quoted called writes dijo escribió citó dit écrit cite sagte schrieb zitierte".split())
#: Signs written for letters.
DISGUISE = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"})
#: ASCII signs that ``bare`` takes off a word's edges.
EDGES = "".join(chr(c) for c in range(128) if not chr(c).isalnum())
_SPLIT = re.compile("[\x20\x09-\x0d]+")
_READ_AS = np.arange(256, dtype=np.uint8)
for _c, _as in DISGUISE.items():
    _READ_AS[_c] = ord(_as)
_IS_SIGN = _READ_AS != np.arange(256)


def split_words(text: str) -> list[str]:
    return [w for w in _SPLIT.split(text) if w]


def bare(word: str) -> str:
    """A lower-case word without the signs at its edges."""
    return _EDGE.sub("", word)


class Trie:
    """A lexicon trie that runs against the Levenshtein automaton of a word."""

    def __init__(self, terms: list[str]):
        self.terms, self.root = terms, {}
        for k, term in enumerate(terms):
            node = self.root
            for c in term:
                node = node.setdefault(c, {})
            node[""] = k
        # within one edit, word and term have a common string among themselves and what one deletion leaves of them
        long = [t for t in terms if len(t) >= FUZZY_LENGTH]
        self.near = {x for t in long for x in (t, *(t[:k] + t[k + 1 :] for k in range(len(t))))}
        # and the first or the last signs of the term stay in place: half of its length
        self.ends = {n: ({t[:n] for t in own}, {t[-n:] for t in own}) for n, own in ((2, [t for t in long if len(t) < 8]), (4, [t for t in long if len(t) >= 8])) if own}
        self.exact = {t: k for k, t in enumerate(terms)}

    def possible(self, word: str) -> bool:
        """False only for words further than one edit from every term."""
        if not any(word[:n] in heads or word[-n:] in tails for n, (heads, tails) in self.ends.items() if (len(word) <= 8 if n == 2 else len(word) >= 7)):
            return False
        near = self.near
        return word in near or any(word[:k] + word[k + 1 :] in near for k in range(len(word)))

    def match(self, word: str, edits: int = 1) -> tuple[int, int] | None:
        """(term, edits) of the nearest term within ``edits``, ties to the first term; None if there is none."""
        if word in self.exact:
            return self.exact[word], 0
        if len(word) < FUZZY_LENGTH - 1 or edits == 1 and not self.possible(word):
            return None
        best: tuple[int, int] | None = None
        # states of the automaton that the trie reaches: node, position in the word, edits used
        seen, stack, n = set(), [(self.root, 0, 0)], len(word)
        while stack:
            node, p, used = stack.pop()
            while True:  # along equal signs; edits branch off
                if used < edits:
                    for c, child in node.items():
                        if c == "":
                            continue
                        stack.append((child, p, used + 1))  # the term has one sign more
                        if p < n and word[p] != c:
                            stack.append((child, p + 1, used + 1))  # another sign
                    if p < n:
                        stack.append((node, p + 1, used + 1))  # the word has one sign more
                if p == n:
                    term = node.get("")
                    if term is not None and len(self.terms[term]) >= FUZZY_LENGTH and (best is None or (used, term) < (best[1], best[0])):
                        best = (term, used)
                    break
                node = node.get(word[p])
                if node is None or (used and edits > 1 and (id(node), p, used) in seen):
                    break
                p += 1
                if used and edits > 1:
                    seen.add((id(node), p - 1, used))
        return best


def lowered(texts: pa.Array) -> pa.Array:
    """Lower-case bytes of a string column."""
    return pc.utf8_lower(texts).cast(pa.binary())


class Scorer:
    """Hits of a block's distinct words first, then features of the texts that hold one."""

    def __init__(self, terms: list[str], weights: list[float]):
        self.trie, self.weights = Trie(terms), weights
        plain = [x for x in self.trie.near | set(terms) if x.isascii()]
        self.near = string_digests([x.encode() for x in plain])
        self.known: dict[bytes, tuple[int, int] | None] = {}

    def match(self, word: str) -> tuple[int, int] | None:
        """(term, edits) of a lower-case word without its edges, or with signs read as letters."""
        plain = bare(word)
        found = self.trie.match(plain) if plain else None
        if found is None and _SIGNS.search(plain):
            found = self.trie.match(bare(word.translate(DISGUISE)))
            found = (found[0], 1) if found else None
        return found

    def candidates(self, words: pa.Array) -> np.ndarray:
        """Positions of all words that may match: ASCII words within one deletion of what one deletion leaves of a term, and all others."""
        if not len(words):
            return np.zeros(0, np.int64)
        data, offsets = buffers_of(words)
        other = np.add.reduceat(np.r_[data >= 128, False].astype(np.int64), offsets[:-1]) > 0
        may = other | within_one_deletion(pc.ascii_trim(words.view(pa.string()), characters=EDGES), self.near)
        signs = np.flatnonzero(~may & (np.add.reduceat(np.r_[_IS_SIGN[data], False].astype(np.int64), offsets[:-1]) > 0))
        if len(signs):
            own = words.take(pa.array(signs))
            data, offsets = buffers_of(own)
            read = pa.Array.from_buffers(pa.binary(), len(own), [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(_READ_AS[data].tobytes())])
            may[signs] = within_one_deletion(pc.ascii_trim(read.view(pa.string()), characters=EDGES), self.near)
        return np.flatnonzero(may)

    def hits(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(term or -1, edits) of each of a column of distinct lower-case words."""
        term, used = np.full(len(words), -1), np.zeros(len(words), np.int64)
        at = self.candidates(words)
        for k, word in zip(at.tolist(), words.take(pa.array(at)).to_pylist(), strict=True):
            found = self.known.get(word, ())
            if found == ():
                found = self.match(str(word, "utf-8", "replace"))
                if len(self.known) < KNOWN_WORDS:
                    self.known[word] = found
            if found:
                term[k], used[k] = found
        return term, used

    def features(self, texts: pa.Array) -> np.ndarray:
        """[texts, FEATURES] of a string column."""
        out = np.zeros((len(texts), FEATURES))
        low = lowered(texts)
        words = Words(low)
        distinct, of = words.distinct()
        term, used = self.hits(distinct)
        where = np.flatnonzero(term[of] >= 0) if len(of) else np.zeros(0, np.int64)
        doc = words.doc[where]
        for d in np.unique(doc).tolist():
            at = where[doc == d] if len(where) < 1000 else where[np.searchsorted(doc, d) : np.searchsorted(doc, d, side="right")]
            found = list(zip(term[of[at]].tolist(), used[of[at]].tolist(), strict=True))
            out[d] = self._features(str(low[d].as_py(), "utf-8", "replace"), (at - words.begin[d]).tolist(), found)
        return out

    def _features(self, text: str, at: list[int], found: list[tuple[int, int]]) -> list[float]:
        words = split_words(text)
        exact = fuzzy = quoted = abuse = 0.0
        terms: dict[int, float] = {}
        marks = np.cumsum([len(_QUOTES.findall(w)) for w in words]) if _QUOTES.search(text) else None
        where = np.array(at)
        near = np.searchsorted(where, where + WINDOW, side="right") - np.searchsorted(where, where - WINDOW, side="left") - 1
        for k, (term, used), others in zip(at, found, near.tolist(), strict=True):
            weight = self.weights[term] * (0.5 if used else 1.0)
            around = words[max(0, k - WINDOW) : k + WINDOW + 1]
            said = (marks is not None and (marks[k - 1] if k else 0) % 2 == 1) or any(bare(w) in REPORTING for w in around)
            terms[term] = max(terms.get(term, 0.0), weight)
            if said:
                quoted += 1
            elif used:
                fuzzy += 1
            else:
                exact += 1
            abuse += 0 if said else math.log1p(others)
        share = 100.0 * len(at) / len(words)
        top = sorted(terms.values(), reverse=True)
        return [math.log1p(exact), math.log1p(fuzzy), math.log1p(quoted), math.log1p(abuse), math.log1p(share), top[0], sum(top[1:3]), math.log1p(len(terms)), 1.0, float(exact > 0)]


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """word, texts of each label that hold it; counts of a block of texts at a time."""
    for table in common.chunks(batches, 0, BLOCK_BYTES):
        counts = (Counter(), Counter())
        for text, toxic in zip(lowered(common.array(table, 0)).to_pylist(), table.column(1).to_pylist(), strict=True):
            counts[toxic].update({b for w in set(split_words(str(text, "utf-8", "replace"))) if len(b := bare(w)) >= TERM_LENGTH})
        words = [*(counts[0].keys() | counts[1].keys())]
        for at in range(0, len(words), 20_000):
            own = words[at : at + 20_000]
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.string()), pa.array([counts[1][w] for w in own], pa.int64()), pa.array([counts[0][w] for w in own], pa.int64())], names=["word", "n1", "n0"])


def _sample_features(terms: list[str], weights: list[float]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(terms, weights)
        for table in common.chunks(batches, 0, BLOCK_BYTES):
            yield pa.RecordBatch.from_arrays([common.array(table, 1), pa.array(scorer.features(common.array(table, 0)).tolist(), pa.list_(pa.float64()))], names=["toxic", "x"])

    return run


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, rounds: int = 40) -> np.ndarray:
    """Weights and intercept by damped Newton steps; the intercept isn't shrunk."""
    x1 = np.c_[x, np.ones(len(x))]
    w = np.zeros(x1.shape[1])
    keep = np.r_[np.full(x.shape[1], ridge), 1e-6]
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x1 @ w, -30, 30)))
        g = x1.T @ (p - y) + keep * w
        h = (x1 * (p * (1 - p))[:, None]).T @ x1 + np.diag(keep + 1e-6)
        step = np.linalg.solve(h, g)
        w -= step * min(1.0, 4.0 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-6:
            break
    return w


def train(docs: DataFrame, labels: DataFrame, per_label: int = SAMPLE_PER_LABEL) -> tuple[list[str], list[float], np.ndarray]:
    """(terms, their log odds, regression weights) from labelled rows outside the held-out third.

    At most ``per_label`` rows of each label, those of least hash, are fitted on. Terms come from two thirds of them,
    the regression from the rest, so it sees terms as precise as they are on new texts.
    """
    common.small_batches(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~common.is_held_out(F.col("doc_id")))
    known = known.groupBy(F.col("doc_id").alias("of")).agg(F.max("toxic").cast("int").alias("toxic"))
    some = None
    for toxic in (0, 1):
        own = known.where(F.col("toxic") == toxic).orderBy(F.xxhash64("of"), "of").limit(per_label)
        some = own if some is None else some.unionByName(own)
    drawn = docs.where(F.col("text").isNotNull()).join(F.broadcast(some), F.col("doc_id") == F.col("of"))
    drawn = common.materialize(drawn.select(F.col("text").cast("string").alias("text"), "toxic", (F.xxhash64("of", F.lit(3)) % 3 == 0).alias("later")))
    totals = {(r["toxic"], r["later"]): r["n"] for r in drawn.groupBy("toxic", "later").agg(F.count("*").alias("n")).collect()}
    split = min(totals.get((1, True), 0), totals.get((0, True), 0)) >= 20
    first = drawn.where("not later") if split else drawn
    n0, n1 = (sum(n for (t, later), n in totals.items() if t == toxic and not (split and later)) for toxic in (0, 1))
    if not n0 or not n1:
        return [], [], np.r_[np.zeros(FEATURES), -2.0]
    counts = first.select("text", "toxic").mapInArrow(_term_counts, "word string, n1 long, n0 long").groupBy("word").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))
    odds = F.log((F.col("n1") + 0.1) / (n1 + 0.2)) - F.log((F.col("n0") + 0.1) / (n0 + 0.2))
    found = counts.withColumn("odds", odds).where((F.col("n1") >= MIN_DOCS) & (F.col("odds") >= MIN_LOG_ODDS)).orderBy(F.desc(F.col("odds") * F.log1p("n1")), "word").limit(LEXICON_TERMS).collect()
    terms, weights = [r["word"] for r in found], [float(r["odds"]) for r in found]
    rows = (drawn.where("later") if split else drawn).select("text", "toxic").mapInArrow(_sample_features(terms, weights), "toxic int, x array<double>").toArrow()
    x, y = np.array(rows.column("x").to_pylist()).reshape(-1, FEATURES), rows.column("toxic").to_numpy().astype(float)
    order = np.lexsort((*x.T, y))
    return terms, weights, fit_logistic(x[order], y[order])


def _score(terms: list[str], weights: list[float], w: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(terms, weights)
        for table in common.chunks(batches, 0, BLOCK_BYTES):
            x = scorer.features(common.array(table, 0))
            p = 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))
            yield pa.RecordBatch.from_arrays([common.array(table, 1), common.array(table, 2), pa.array(p), pa.array((p >= THRESHOLD).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return run


def score(docs: DataFrame, labels: DataFrame, model: tuple[list[str], list[float], np.ndarray] | None = None) -> DataFrame:
    """One row per document: doc_id, held_out, score in [0, 1], predicted (1 from a score of 0.7).

    Whole texts are scored; null and empty ones get the score of a text without hits. Without labels of both kinds
    there is no lexicon and every score is low. Repeated rows score alike; a null doc_id counts as held out. Columns
    other than doc_id and text (of labels: doc_id and toxic) are ignored, whatever their names; an empty table gives an
    empty result.

    Limits of the model: the lexicon holds the LEXICON_TERMS strongest terms of TERM_LENGTH letters or more that
    MIN_DOCS sampled texts hold; terms under FUZZY_LENGTH letters are found only as they are (or with signs for
    letters), longer ones also with one insertion, deletion or substitution, but not with two letters swapped.
    """
    model = model or train(docs, labels)
    rows = common.documents(docs).select("text", "doc_id", common.is_held_out(F.col("doc_id")).alias("held_out"))
    return rows.mapInArrow(_score(*model), "doc_id long, held_out boolean, score double, predicted int")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))
