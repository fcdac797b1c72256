"""Words, units and suffixes as arrays against plain Python."""

import random

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("graphloom.llm")
from graphloom.llm import common, near_dedup, substring_dedup, units  # noqa: E402
from graphloom.llm.words import SEGMENT, Words  # noqa: E402

TEXTS = ["", " a  b\tc ", "x", "yy", "  ", "日本 a\x0b\x85b", "A B c a", "long" * SEGMENT, "a b", "nb\xa0sp \xa0wide  x 　y ’z \x85q", "foo \n bar\tbaz  \t qq \x1c w", "it's we'll", "🙂 e’s  🙂", "x <|endoftext|> a  <|endoftext|>b", "one\n\ntwo   three "]


def _column(texts):
    return pa.array([t.encode() for t in texts], pa.binary())


def test_words():
    words = Words(_column(TEXTS))
    found = [bytes(words.data[a:b]) for a, b in zip(words.first, words.last, strict=True)]
    assert found == [x for t in TEXTS for x in t.encode().split()]
    assert words.sizes.tolist() == [len(t.encode().split()) for t in TEXTS]
    for numbers, key in ((words.digests(), bytes), (words.distinct()[1], bytes), (words.digests(fold=True), bytes.lower)):
        assert len(set(zip(numbers.tolist(), map(key, found), strict=True))) == len(set(numbers.tolist())) == len(set(map(key, found)))
    assert len(Words(_column([]))) == 0 and len(Words(_column(["", " "]))) == 0
    sliced = Words(_column(TEXTS).slice(1, 2))
    assert sliced.sizes.tolist() == [3, 1]


def test_shingle_sets():
    rng = random.Random(1)
    texts = [" ".join(rng.choice("abCdE") for _ in range(rng.randint(0, 12))) for _ in range(60)]
    for size in (2, 5):
        x, ends = near_dedup.shingle_sets(_column(texts), size)
        digests = near_dedup.class_digests(*near_dedup.shingle_sets(_column([t for t in texts if t.split()]), size)).to_pylist()
        sets = []
        for t in texts:
            w = t.lower().split()
            sets.append(frozenset(tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))) if w else frozenset())
        assert np.diff(ends).tolist() == [len(s) for s in sets]
        named = {}
        for s, a, b in zip(sets, ends[:-1], ends[1:], strict=True):
            assert named.setdefault(s, x[a:b].tolist()) == x[a:b].tolist()
        assert len(set(zip([s for s in sets if s], digests, strict=True))) == len(set(digests)) == len({s for s in sets if s})


@pytest.mark.parametrize("known", [False, True])
def test_units(known):
    path = common.tokenizer_path()
    encoder = units.Encoder(path)
    rng = random.Random(2)
    texts = TEXTS + ["".join(rng.choice(["a", " ", "  ", "\n", "b1", "'s", "\xa0", "é", ".", "\t"]) for _ in range(rng.randint(0, 40))) for _ in range(300)]
    coder = units.Coder(path, units.Table.empty(encoder.id_type).packed(), 10_000 if known else 0)
    for _ in range(2):
        got = [x.tolist() for at in range(0, len(texts), 50) for x in coder.arrays(_column(texts).slice(at, 50))]
        assert got == [x.ids for x in encoder.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


def test_sorted_suffixes():
    rng = random.Random(3)
    for depth in (1, 2, 5, 13):
        codes = np.array([rng.randint(0, 2) for _ in range(200)])
        starts = np.arange(0, 200 - depth + 1)
        order, shared = substring_dedup.sorted_suffixes(codes, starts, depth)
        rows = [tuple(codes[s : s + depth]) for s in starts[order]]
        assert rows == sorted(rows)
        for k in range(1, len(rows)):
            n = next((j for j in range(depth) if rows[k][j] != rows[k - 1][j]), depth)
            assert shared[k] == n


@pytest.mark.parametrize("group,frequent,sent", [(30_000, 20_000, 20_000), (3, 0, 0), (5, 2, 1)])
def test_maximal_repeats(spark, monkeypatch, group, frequent, sent):
    """Passages over hot and rare windows, in small groups too; rows that repeat a doc_id with other texts."""
    monkeypatch.setattr(substring_dedup, "GROUP_ROWS", group)
    monkeypatch.setattr(substring_dedup, "SENT_LEAVES", sent)
    rng = random.Random(4)
    fresh = iter(f"n{k}" for k in range(10**6))
    new = lambda n: [next(fresh) for _ in range(n)]
    hot, rare, loop = new(20), new(40), ["la"] * 30
    rows = [(7, new(5) + rare + new(9)), (3, new(20)), (9, rare[3:33] + hot), (9, new(4) + loop), (7, hot + new(3)), (None, rare + hot)]
    rows += [(100 + k, new(rng.randint(0, 6)) + (hot if k % 3 else loop[: 10 + k]) + new(4)) for k in range(30)]
    rng.shuffle(rows)
    first = {}
    for i, w in rows:
        for k in range(len(w) - 12 if i is not None else 0):
            key = tuple(w[k : k + 13])
            first[key] = min(i, first.get(key, i))
    ranges, cut = [], []
    for i, w in rows:
        starts = [k for k in range(len(w) - 12) if i is not None and first[tuple(w[k : k + 13])] < i]
        for k in starts:
            if k - 1 not in starts:
                end = k
                while end + 1 in starts:
                    end += 1
                ranges.append((i, k, end + 13))
        gone = {k + j for k in starts for j in range(13)}
        cut.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string").repartition(3)
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(map(tuple, substring_dedup.maximal_repeats(docs, frequent=frequent).collect())) == sorted(ranges)
    assert sorted(map(tuple, substring_dedup.remove_repeats(docs, frequent=frequent).collect()), key=key) == sorted(cut, key=key)
