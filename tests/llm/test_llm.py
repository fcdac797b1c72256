"""The operators against plain Python on a small table with nulls, empty and long texts, ties and repeated rows."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

llm = pytest.importorskip("graphloom.llm")
from graphloom.llm import ann, bpe, common, exact_dedup, language_id, mixing, near_dedup, pii, substring_dedup, token_files, toxicity  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, size string"


def rows():
    rng = random.Random(3)
    words = ["alpha", "beta", "gamma", "delta", "Omega,", "naïve", "日本語", "x"] + [f"w{k}" for k in range(300)]
    passage = " ".join(rng.choice(words) for _ in range(40))
    texts = [None, "", "   ", "one", "One", "a  b\t\nc", "a b c", "<|endoftext|> a  <|endoftext|>b", "tail   \n\n  x ", " lead", " nbsp   wide", "🙂 emoji’s"]
    for k in range(40):
        body = [rng.choice(words) for _ in range(rng.randint(5, 120))]
        texts.append(" ".join(body) + (" " + passage if k % 5 == 0 else ""))
    texts += [texts[20], texts[20] + " extra", texts[25], " ".join(rng.choice(words) for _ in range(6000))]
    out = [(k * 7 % 101, t, ["en", None, "fr"][k % 3], [None, "b", "a", ""][k % 4], 1, True, "clash") for k, t in enumerate(texts)]
    return out + [out[15]]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def texts():
    return [(i, t or "") for i, t, *_ in rows()]


def test_exact(docs, none):
    norm = lambda t: __import__("re").sub(r"[\x20\x09-\x0D]+", " ", t)
    groups = {}
    for i, t in texts():
        groups.setdefault(norm(t), []).append(i)
    want = sorted((i, min(groups[norm(t)]), len(groups[norm(t)]), i == min(groups[norm(t)]), hashlib.sha256(norm(t).encode()).hexdigest()) for i, t in texts())
    assert sorted(map(tuple, exact_dedup.exact_dedup(docs, digest_all=True).collect())) == want
    assert [tuple(r)[:4] for r in exact_dedup.exact_dedup(docs, broadcast_groups=0).orderBy("doc_id").collect()] == [w[:4] for w in want]
    assert exact_dedup.exact_dedup(none).count() == 0


@pytest.mark.parametrize("size,block", [(2, 2048), (5, 2)])
def test_near(docs, none, size, block):
    sets = {}
    for i, t in texts():
        w = t.encode().lower().split()
        sets[i] = {tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()
    least = {i: i for i in sets}
    for _ in range(6):
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    least[a] = least[b] = min(least[a], least[b])
    got = near_dedup.near_duplicates(docs, shingle=size, block=block).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in got} == {i: (len(sets[i]), least[i], least[i] == i) for i in sets}
    assert len(got) == len(texts())
    assert near_dedup.near_duplicates(none).count() == 0


def test_spanning_candidates_cut_nothing_off(monkeypatch):
    rng = random.Random(11)
    graphs = [(6, {(0, 2), (3, 4), (1, 5), (2, 5), (4, 5)})]
    for _ in range(2000):
        n = rng.randint(4, 12)
        graphs.append((n, {tuple(sorted(rng.sample(range(n), 2))) for _ in range(rng.randint(2, n))}))
    for n, edges in graphs:
        near = lambda one, many, least: np.array([k for k, x in enumerate(many[:, 0].tolist()) if tuple(sorted((one[0], x))) in edges], int)  # noqa: B023, E731
        monkeypatch.setattr(near_dedup, "_survivors", near)
        label = list(range(n))
        for i, j in near_dedup.spanning_candidates(np.arange(n)[:, None], []):
            assert tuple(sorted((i, j))) in edges
            label = [label[i] if k == label[j] else k for k in label]
        assert all(label[i] == label[j] for i, j in edges)


def test_posterior():
    for n, m in near_dedup.least_matches(0.8, 1e-5):
        assert 0 < m < 0.8 * n


def test_bpe_and_files(docs, none, spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(common.tokenizer_path())
    tok.no_truncation(), tok.no_padding()
    ids = {i: tok.encode(t, add_special_tokens=False).ids for i, t in texts()}
    got = bpe.encode_decode(docs).collect()
    assert len(got) == len(texts())
    for r in got:
        assert r["ids"] == ids[r["doc_id"]] and r["n_tokens"] == len(r["ids"])
        assert r["decoded"] == tok.decode(r["ids"], skip_special_tokens=False)
    assert bpe.encode_decode(none).count() == 0
    uri, manifest = token_files.write_token_files(docs, shard_docs=10)
    start = 0
    for r in token_files.read_token_files(uri, manifest).orderBy("start").collect():
        want = np.array([*ids[r["doc_id"]], 0], "<u4")
        assert (r["start"], r["ids"], r["ids_crc32"]) == (start, want.tolist(), zlib.crc32(want.tobytes()))
        start += len(want)
    file = manifest.orderBy("shard").first()["file"]
    assert any(token_files.read_document(uri, file, i) is not None for i in ids)
    uri, manifest = token_files.write_token_files(none)
    assert token_files.read_token_files(uri, manifest).count() == 0


@pytest.mark.parametrize("frequent", [50_000, 0])
def test_repeats(docs, none, frequent):
    first = {}
    for i, t in texts():
        w = t.encode().split()
        for k in range(len(w) - 12):
            first[tuple(w[k : k + 13])] = min(i, first.get(tuple(w[k : k + 13]), i))
    got = substring_dedup.remove_repeats(docs, frequent=frequent).collect()
    for r in got:
        w = dict(texts())[r["doc_id"]].encode().split()
        gone = set()
        for k in range(len(w) - 12):
            if first[tuple(w[k : k + 13])] < r["doc_id"]:
                gone |= set(range(k, k + 13))
        assert (r["n_words"], r["n_removed"]) == (len(w), len(gone))
        assert r["kept_text"].encode() == b" ".join(x for k, x in enumerate(w) if k not in gone)
    assert len(got) == len(texts()) and substring_dedup.remove_repeats(none).count() == 0


def test_mix(docs):
    sized = mixing.word_counts(docs.select("doc_id", "source", "text")).withColumn("weight", F.lit(1.0))
    assert {(r["doc_id"], r["size"]) for r in sized.collect()} == {(i, len(t.encode().split())) for i, t in texts()}
    got = mixing.mix(sized).collect()
    again = mixing.mix(sized).collect()
    assert sorted((r["doc_id"], r["taken"]) for r in got) == sorted((r["doc_id"], r["taken"]) for r in again) and len(got) == len(texts())
    taken = {}
    for r in got:
        assert r["taken"] <= 3 * r["size"]
        taken.setdefault((r["source"], r["target"]), []).append(r["taken"])
    assert all(abs(sum(v) - t) < 1.0001 for (_, t), v in taken.items())


def test_targets():
    got = mixing.targets([("b", 10), (None, 100), ("a", 1)])
    assert [x[0] for x in got] == ["a", "b", None] and got[0][2] == 3.0 and abs(sum(x[2] for x in got) - 111) < 1e-9


def test_language(docs, none):
    got = language_id.identify(docs).collect()
    assert len(got) == len(texts()) and all(0 <= r["score"] <= 1 for r in got)
    by = {r["doc_id"]: r["lang_pred"] for r in got}
    assert by[0] == "und" and by[7] == "und"  # null and empty texts
    assert language_id.identify(none).count() == 0


def test_ann(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(900, 16)).astype(np.float32)
    x[5] = x[7]
    data = [(k, v.tolist()) for k, v in enumerate(x)] + [(1000, None), (1001, [0.0] * 16), (1002, [float("nan")] * 16), (1003, [])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>")
    got = {}
    for r in ann.search(df, df.where("vec_id % 20 = 0"), part_rows=200, block_rows=64).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
    hit = 0
    for q, found in got.items():
        s = x.astype(float) @ x[q].astype(float)
        s[q] = -np.inf
        hit += len({i for _, i in found} & set(np.argsort(-s)[:20].tolist()))
        assert sorted(k for k, _ in found) == list(range(1, 21))
    assert len(got) == 45 and hit >= 0.9 * 45 * 20
    assert ann.search(df.where("false"), df).count() == 0


def test_pii(spark, none):
    text = "Mail me: a.b@x.example.com, host 10.0.0.300 or 10.0.0.30, card 4111 1111 1111 1111, phone +1 (555) 555-0100."
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")
    got = {r["doc_id"]: [(s["kind"], text[s["start"] : s["end"]]) for s in r["spans"] if s["base"]] for r in pii.find_pii(df).collect()}
    assert [k for k, _ in got[1]] == ["email", "ip", "card", "phone"] and got[1][1][1] == "10.0.0.30" and got[2] == got[3] == []
    assert pii.find_pii(none).count() == 0


def test_toxicity(spark, docs, none):
    trie = toxicity.Trie(["idiot", "pathetic"])
    assert [trie.match(w) for w in ("idiot", "idot", "ldiot", "idiiot", "pathetics", "idoit", "pat")] == [(0, 0), (0, 1), (0, 1), (0, 1), (1, 1), None, None]
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    rng, terms = random.Random(1), ["abcde", "abcdefgh", "bcdeabc"]
    own = toxicity.Trie(terms)
    for _ in range(3000):
        w = "".join(rng.choice("abcdefgh") for _ in range(rng.randint(4, 9))) if rng.random() < 0.3 else "".join(c for c in rng.choice(terms) if rng.random() > 0.1) + rng.choice(["", "a", "h"])
        want = min(((distance(w, t), k) for k, t in enumerate(terms)), default=(9, 0))
        if len(w) >= 4:
            assert own.match(w) == ((want[1], want[0]) if want[0] <= 1 else None), w
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = toxicity.score(docs, labels).collect()
    assert len(got) == len(texts()) and all(0 <= r["score"] < 0.7 for r in got)
    assert toxicity.score(none, labels).count() == 0


def test_language_looks_at_whole_texts(spark):
    signs = ["² " + "1 " * 150 + "hello world", "½ " * 300 + "x", "Ⅳ ① ² 12"]
    rows = [(k, t, None, None, 1, True, "") for k, t in enumerate(signs)] + [(7, "hello world of letters", "en", "a", 1, True, ""), (8, "hello again world", "en", "a", 1, True, ""), (9, "hello world", "en", "a", 1, True, "")]
    got = {r["doc_id"]: (r["lang_pred"], r["score"] > 0) for r in language_id.identify(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert [got[k] for k in range(3)] == [("en", True), ("en", True), ("und", False)]
