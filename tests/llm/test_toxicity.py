"""Hits of whole blocks against word by word, and the trained score on held-out documents."""

import random
import zlib

import pyarrow as pa
import pytest

pytest.importorskip("graphloom.llm")
from graphloom.llm import toxicity  # noqa: E402

TERMS = ["idiot", "pathetic", "scum", "moron", "dégueulasse", "worthless", "abc"]


def test_hits_are_those_of_each_word():
    rng = random.Random(8)
    scorer = toxicity.Scorer(TERMS, [1.0] * len(TERMS))
    words = {"", "!!", "a", "\0idiot"}
    for _ in range(4000):
        w = list(rng.choice(TERMS))
        for _ in range(rng.randint(0, 3)):
            k = rng.randrange(len(w) + 1)
            w[k : k + rng.randint(0, 1)] = rng.choice(["", "x", "é", "0", "1", "@", "$", ".", "日", "!"])
        words.add("".join([rng.choice(["", "(", '"', "_", "«"]), *w, rng.choice(["", ",", "!", "'s", "”"])]))
    words = sorted(words)
    term, used = scorer.hits(pa.array([w.encode() for w in words], pa.binary()))
    for w, t, u in zip(words, term.tolist(), used.tolist(), strict=True):
        assert scorer.match(w) == ((t, u) if t >= 0 else None), w


def test_learns_from_the_other_two_thirds(spark):
    rng = random.Random(9)
    plain = [f"word{k}" for k in range(200)]
    rows, labels = [], []
    for k in range(900):
        body = [rng.choice(plain) for _ in range(rng.randint(3, 60))]
        toxic = k % 3 == 0
        if toxic:
            for _ in range(3):
                body.insert(rng.randrange(len(body) + 1), rng.choice(["idiot", "pathetic", "moron", "worthless", "idi0t"]))
        rows.append((k, " ".join(body), "src", "clash", "clash"))
        labels.append((k, 1, int(toxic), "clash"))
    rows += [(5000, None, "", "", ""), (5001, "", "", "", ""), (None, "you pathetic worthless idiot moron", "", "", ""), (5002, "you pathetic worthless idiot moron " * 20_000, "", "", "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, toxic string, of string")
    got = toxicity.score(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text string")).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    for k, _, toxic, _ in labels:
        r = by[k]
        assert r["held_out"] == (zlib.crc32(str(k).encode()) % 3 == 1)
        assert r["predicted"] == toxic == int(r["score"] >= 0.7)
    assert by[5000]["score"] == by[5001]["score"] < 0.5 and by[None]["held_out"] and by[5002]["predicted"] == by[None]["predicted"] == 1
