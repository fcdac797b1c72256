"""Operators against plain versions: personal data, language mixtures, mixing, neighbours, hot groups, every query once."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("graphloom.llm")
from graphloom.llm import ann, bpe, common, exact_dedup, language_id, mixing, near_dedup, pii, queries, toxicity  # noqa: E402

SF = "/root/testdata/sf0.001"


def _plain_base(text):
    out = [("email", m.start(), m.end()) for m in re.finditer(pii.BASE["email"], text)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(pii.BASE["ip"], text) if all(int(x) <= 255 for x in m.group().split("."))]
    for m in re.finditer(pii.BASE["card"], text):
        d = [int(c) for c in m.group() if c.isdigit()][::-1]
        if 13 <= len(d) <= 19 and sum(x if k % 2 == 0 else sum(divmod(2 * x, 10)) for k, x in enumerate(d)) % 10 == 0:
            out.append(("card", m.start(), m.end()))
    return out + [("phone", m.start(), m.end()) for m in re.finditer(pii.BASE["phone"], text) if 9 <= sum(c.isdigit() for c in m.group()) <= 15]


def test_base_spans():
    rng = random.Random(6)
    bits = ["a", "b.c", "@", ".", "-", "1", "22", "255", "256", "007", "+", " ", "(", ")", "4111 1111 1111 1111", "é", "+1 555", "x@y.z", "_", "%", "\n", "10.0.0.1", "٣"]
    for _ in range(4000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 25)))
        assert pii.base_spans(text) == _plain_base(text), text


def test_matching_is_linear():
    began = time.process_time()
    for run in ("1" * 10**6, "a" * 10**6, "a." * 500_000, "1." * 500_000, "@a" * 400_000, "+1 (" * 200_000, "a" * 10**6 + "@", "(at)x" * 200_000):
        pii.base_spans(run), pii.loose_spans(run)
    assert time.process_time() - began < 20


def test_personal_data_gain(spark):
    """Hidden phones and mails are found, decoys aren't; counts and digests hold base spans only."""
    rng = random.Random(7)
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    rows, hidden, decoys = [], set(), set()
    for k in range(600):
        text = "some words here "
        if k % 4 == 0:
            text += rng.choice(["call ", "phone ", "so "]) + f"+1 ({d(3)}) 555-{d(4)} and mail a{d(2)}@mail.example.com then"
        elif k % 4 == 1:
            at = len(text) + 5
            text += f"call ({d(3)}) 555-{d(4)} today"
            hidden.add((k, "phone", at, at + 14))
        elif k % 4 == 2:
            at = len(text) + 5
            text += f"mail bob{d(2)} [at] host{d(1)}.com now"
            hidden.add((k, "email", at, at + 20))
        else:
            at = len(text) + 8
            number = d(16)
            text += f"invoice {number} paid"
            if not pii.luhn(number):
                decoys.add((k, "card", at, at + 16))
        rows.append((k, text, "clash"))
    rows += [(900, None, ""), (901, "", "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    added = {(r["doc_id"], s["kind"], s["start"], s["end"]) for r in pii.find_pii(df).collect() for s in r["spans"] if not s["base"]}
    assert len(added & hidden) >= 0.9 * len(hidden) and len(added & decoys) <= 0.1 * len(decoys)
    for r in pii.find_pii(df).mapInArrow(pii._digest, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string").collect():
        base = _plain_base(dict((i, t) for i, t, _ in rows)[r["doc_id"]] or "")
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(x[0] == k for x in base) for k in pii.KINDS]
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()


def test_label_model_finds_reliabilities():
    """EM against the draws it was made from: good labelers outvote a bad one."""
    rng = random.Random(8)
    counts, truth = Counter(), Counter()
    for _ in range(20_000):
        y = rng.random() < 0.4
        v = tuple((1 if y else -1) * (1 if rng.random() < p else -1) for p in (0.95, 0.9, 0.85, 0.8, 0.5))
        counts["ip", v] += 1
        truth["ip", v] += y
    keys = sorted(counts)
    soft = pii.label_model(keys, [counts[k] for k in keys])
    common_ = [k for k in keys if counts[k] >= 100]
    assert common_ and all(abs(soft[k] - truth[k] / counts[k]) < 0.1 for k in common_)


def _plain_mixture(text, logp):
    """Forward selection with EM for one text, language by language."""
    words, last = [], None
    for _, _, data, _ in language_id._pieces([text]):
        slot, letter, begins = language_id._slots(data)
        for s, is_letter, begin in zip(slot.tolist(), letter.tolist(), begins.tolist(), strict=True):
            if is_letter:
                if begin:
                    words.append(np.zeros(logp.shape[1]))
                words[-1] = words[-1] + logp[s]
    if not words:
        return np.zeros(logp.shape[1])
    w, k = np.array(words), logp.shape[1]
    peak = w.max(1)
    like = np.exp(w - peak[:, None])
    penalty = 0.5 * np.log(len(w) + 1.0)
    single = w.sum(0)
    member, value = {int(single.argmax())}, single.max() - penalty
    pick = np.eye(k)[single.argmax()]

    def em(languages):
        pi = np.array([float(x in languages) for x in range(k)])
        pi /= pi.sum()
        for _ in range(language_id.ROUNDS):
            joint = like * pi
            pi = (joint / joint.sum(1, keepdims=True)).mean(0)
        return pi, (np.log((like * pi).sum(1)) + peak).sum()

    while len(member) < k:
        options = [(em(member | {x}), x) for x in range(k) if x not in member]
        (pi, ll), x = max(options, key=lambda o: o[0][1])
        if ll - (len(member) + 1) * penalty <= value:
            break
        member, value, pick, last = member | {x}, ll - (len(member) + 1) * penalty, pi, x
    return pick


def test_language_mixtures():
    rng = random.Random(9)
    stems = {"a": "the king ing thing hath wha", "b": "le eau oux queux aille", "c": "der sch ung eit zu"}
    word = lambda x: "".join(rng.choice(stems[x].split()) for _ in range(2))
    counts = np.zeros((language_id.SLOTS, 3))
    for k, x in enumerate("abc"):
        for _, _, data, _ in language_id._pieces([" ".join(word(x) for _ in range(4000)).encode()]):
            slot, letter, _ = language_id._slots(data)
            counts[:, k] += np.bincount(slot[letter], minlength=language_id.SLOTS)
    logp = np.log((counts + 0.1) / (counts.sum(0) + 0.1 * (counts.sum(1) > 0).sum())).astype(np.float32)
    texts = ["", "12 34", "x"] + [" ".join(word(x) for x in langs for _ in range(rng.randint(1, 40))) for langs in ("a", "b", "c", "ab", "bc", "abc", "aab", "ca") for _ in range(6)]
    got = language_id.infer([t.encode() for t in texts], logp)
    for t, row in zip(texts, got, strict=True):
        assert np.allclose(row, _plain_mixture(t.encode(), logp), atol=0.02), t
    assert (got[-1] > 0).sum() == 2


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    truth = {r["doc_id"]: r["lang"] for r in docs.collect()}
    got = [r for r in language_id.op8_language_id(spark, SF).collect() if r["held_out"] and truth[r["doc_id"]] and r["lang_pred"] != "und"]
    assert len(got) > 20 and sum(r["lang_pred"] == truth[r["doc_id"]] for r in got) >= 0.95 * len(got)


def test_mix_takes_what_a_plain_run_takes(spark):
    rng = random.Random(10)
    rows = [(k if k % 50 else None, rng.choice(["a", "b", "c", None]) if k % 3 else "a", rng.randint(0, 60), rng.choice([1.0, 2.0, 0.5])) for k in range(800)]
    rows += [(7, "b", 12, 1.0), (7, "b", 12, 1.0)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, source string, size long, weight double, bucket int, inside int")
    got = Counter((r["doc_id"], r["source"], r["size"], r["taken"]) for r in mixing.mix(df).collect())
    totals = Counter()
    for _, s, n, _ in rows:
        totals[s] += n
    want = Counter()
    for source, total, target in mixing.targets(list(totals.items())):
        epochs = min(int(target // total), 3)
        rest = 0 if epochs >= 3 else math.floor(target) - epochs * total

        def key(r):
            u = (int(hashlib.md5(f"mix:{'null' if r[0] is None else r[0]}".encode()).hexdigest()[:12], 16) + 1) / (1 << 48)
            return -math.log(u) / r[3], -1 if r[0] is None else r[0], r[2]

        for r in sorted((r for r in rows if r[1] == source), key=key):
            more = min(r[2], max(0, rest))
            rest -= more
            want[r[0], source, r[2], epochs * r[2] + more] += 1
    assert got == want
    assert mixing.mix(df.where("false")).count() == 0


def _vectors(spark, x, more=()):
    return spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)] + list(more), "vec_id long, embedding array<float>")


def _recall(found, x, asked, k=20):
    x, hit = x.astype(float), 0
    for q in asked:
        s = x @ x[q]
        s[q] = -np.inf
        hit += len({r["vec_id"] for r in found if r["query_id"] == q} & set(np.argsort(-s, kind="stable")[:k].tolist()))
    return hit / (k * len(asked))


def test_neighbours_of_clusters_ask_few_partitions(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(24, 16)) * 4
    x = (centres[rng.integers(0, 24, 2400)] + rng.normal(size=(2400, 16))).astype(np.float32)
    df = _vectors(spark, x)
    w, probes = ann.model_of(ann._valid(df), 2400, part_rows=200)
    assert w.shape == (17, 12) and probes <= 6
    found = ann.search(df, df.where("vec_id % 20 = 0"), part_rows=200).collect()
    assert _recall(found, x, range(0, 2400, 20)) >= 0.9


def test_model_is_in_use_on_small_tables(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    w, probes = ann.model_of(ann._valid(df), df.count())
    assert w.shape[1] >= 2 and 1 <= probes <= w.shape[1]
    x = np.array([r["embedding"] for r in df.orderBy("vec_id").collect()], np.float32)
    ids = [r["vec_id"] for r in df.orderBy("vec_id").collect()]
    found = ann.op2_ann(spark, SF).collect()
    place = {v: k for k, v in enumerate(ids)}
    assert {r["query_id"] for r in found} == {v for v in ids if v % 20 == 0}
    for r in found:
        assert abs(r["score"] - float(x[place[r["query_id"]]].astype(float) @ x[place[r["vec_id"]]].astype(float))) < 1e-12
    hit = 0
    for q in {r["query_id"] for r in found}:
        s = x.astype(float) @ x[place[q]].astype(float)
        s[place[q]] = -np.inf
        hit += len({r["vec_id"] for r in found if r["query_id"] == q} & {ids[k] for k in np.argsort(-s, kind="stable")[:20]})
    assert hit >= 0.9 * len(found)


def test_neighbours_of_odd_rows(spark):
    """Ties to the smaller id, repeated ids, null ids, other dimensions, fewer candidates than asked for."""
    one, two = [1.0, 0.0], [0.5, 0.5]
    more = [(0, one), (3, one), (1, one), (1, two), (2, two), (None, one), (40, [1.0, 0.0, 0.0]), (41, [2.0, 0.0, 1.0]), (60, None), (80, [0.0, 0.0]), (100, [float("inf"), 1.0])]
    df = spark.createDataFrame(more, "vec_id long, embedding array<float>").withColumn("score", F.lit("clash"))
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in ann.search(df, df.where("vec_id % 20 = 0")).collect())
    assert got == [(0, 1, 1, 1.0), (0, 2, 3, 1.0), (0, 3, 2, 0.5), (40, 1, 41, 2.0)]


def test_hot_groups_join_back_by_broadcast(spark):
    rows = [(k, "same text" if k % 3 == 0 else f"t{k % 40}", "clash") for k in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n string")
    groups = {}
    for i, t, _ in rows:
        groups.setdefault(t, []).append(i)
    want = sorted((i, min(groups[t]), len(groups[t])) for i, t, _ in rows)
    for hot, bound in ((5, 200_000), (5, 0), (10**6, 200_000)):
        got = exact_dedup.exact_dedup(df, broadcast_groups=bound, hot_group=hot).collect()
        assert sorted((r["doc_id"], r["keep_id"], r["group_size"]) for r in got) == want


def test_columns_with_clashing_names(spark):
    names = ["block", "row", "toxic", "of", "size", "bucket", "inside", "before", "text_sha256", "held_out", "spans", "digest", "cid", "n", "slot", "shard"]
    df = spark.createDataFrame([(1, "some text here", "s", *range(len(names))), (2, None, None, *range(len(names)))], f"doc_id long, text string, source string, {', '.join(f'{x} int' for x in names)}")
    labels = spark.createDataFrame([(1, 1, 1, "x")], "doc_id long, quality int, toxic int, text string")
    assert bpe.encode_decode(df).count() == toxicity.score(df, labels).count() == near_dedup.near_duplicates(df).count() == 2
    assert exact_dedup.exact_dedup(df).count() == pii.find_pii(df).count() == language_id.identify(df.withColumn("lang", F.lit("en"))).count() == 2
    sized = mixing.word_counts(df)
    assert {(r["doc_id"], r["size"]) for r in sized.collect()} == {(1, 3), (2, 0)}
    assert mixing.mix(sized.withColumn("weight", F.lit(1.0))).count() == 2


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_every_query_covers_its_table(spark, name):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = queries.QUERIES[name](spark, SF)
    if name == "op2_ann":
        return
    rows = got.collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(r["doc_id"] for r in docs.select("doc_id").collect())
    if name == "op3_token_files":
        start = 0
        for r in sorted(rows, key=lambda r: r["doc_id"]):  # ids stand in ascending doc_id
            assert r["start"] == start
            start += r["n_tokens"]
    if name == "op4_mix_sources":
        assert sum({r["source"]: r["target"] for r in rows}.values()) == pytest.approx(sum(r["size"] for r in rows), abs=1e-3)
    if "held_out" in got.columns:
        assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)


def test_release_is_harmless():
    common.release()
