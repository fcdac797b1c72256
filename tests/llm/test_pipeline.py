"""The pipeline against plain Python on documents with null, repeated and equal ids."""

import hashlib
import math
import random
import re
from collections import Counter

import pytest

pytest.importorskip("graphloom.llm")
corpus_pipeline = pytest.importorskip("corpus_pipeline")
from graphloom.llm import common, mixing  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def _rows():
    rng = random.Random(5)
    words = {"en": [f"the{k}ing" for k in "abcdefghijklmnop"], "fr": [f"le{k}eau" for k in "abcdefghijklmnop"]}

    def text(n, lang="en"):
        return " ".join(rng.choice(words[lang]) for _ in range(n))

    rows = [(100 + k, text(30 + k, lang), lang, "abc"[k % 3]) for k in range(24) for lang in [["en", "fr"][k % 2]]]
    x, y, z, lone = text(80), text(70), text(61), text(50)
    rows += [(5, x, "en", "a"), (5, y, "en", "a"), (1, y, "en", "b")]  # 5 stays for x, its y is a copy of 1
    rows += [(9, x + " more", "en", "a"), (None, x + " end", "en", "a")]  # near copies of (5, x)
    rows += [(None, lone, "en", "b"), (None, lone.replace(" ", "  ", 3), "en", "b")]  # equal, without any id
    rows += [(None, text(45), "en", "c"), (None, text(46), None, "c"), (None, y, "en", "a")]
    rows += [(7, z, "en", "a"), (7, z, "en", "a"), (7, text(55), "en", None), (8, text(56), "en", None), (8, text(57), "en", None)]
    rows += [(20, "12 34", "en", "a"), (None, "12 34", "en", "a"), (21, None, "en", "a"), (None, "", None, None)]
    return [(*r, len(r[1] or "")) for r in rows]


def _first(rows):
    return min(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))


def _exact(rows):
    groups = {}
    for r in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r[1]), []).append(r)
    return [_first(g) for g in groups.values()]


def _near(rows):
    sets = []
    for r in rows:
        w = r[1].lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))})
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if label[i] != label[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                label = [label[j] if k == label[i] else k for k in label]
    return [_first([r for r, k in zip(rows, label, strict=True) if k == of]) for of in set(label)]


def _mix(rows, weight):
    """(doc_id, text) as often as the mix takes it."""
    size = lambda r: len(r[1].split())
    totals = Counter()
    for r in rows:
        totals[r[3]] += size(r)
    out = []
    for source, total, target in mixing.targets(list(totals.items())):
        epochs = min(int(target // total), 3)
        rest = 0 if epochs >= 3 else math.floor(target) - epochs * total

        def key(r):
            u = (int(hashlib.md5(f"mix:{'null' if r[0] is None else r[0]}".encode()).hexdigest()[:12], 16) + 1) / (1 << 48)
            return -math.log(u) / weight.get(r[0], 1.0), -1 if r[0] is None else r[0], size(r)

        for r in sorted((r for r in rows if r[3] == source), key=key):
            more = min(size(r), max(0, rest))
            rest -= more
            out += [r[:2]] * math.floor((epochs * size(r) + more) / size(r) + 0.5)
    return out


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("pipeline"))
    spark.createDataFrame(_rows(), SCHEMA).repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(k, k % 2, 0) for k in range(100, 112)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d


def test_stages_keep_one_row_of_each_group(spark, folder):
    """Each stage by itself, on rows that no earlier stage has named."""
    docs = common.table(spark, folder, "documents").where("text rlike '[a-z]'")
    rows = [r for r in _rows() if re.search("[a-z]", r[1] or "")]
    norm = lambda rows: Counter((r[0], " ".join(r[1].split())) for r in rows)
    assert norm(corpus_pipeline.exact(spark, docs, folder).collect()) == norm(_exact(rows))
    assert norm(corpus_pipeline.near(spark, docs, folder).collect()) == norm(_near(rows))
    assert Counter((r[0], r[1]) for r in corpus_pipeline.by_language(spark, common.table(spark, folder, "documents"), folder).collect()) == Counter(r[:2] for r in rows)


def test_run(spark, folder):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(common.tokenizer_path())
    tok.no_truncation(), tok.no_padding()
    rows = [r for r in _rows() if re.search("[a-z]", r[1] or "")]
    found = _mix(_near(_exact(rows)), {k: 2.0 if k % 2 else 0.5 for k in range(100, 112)})
    squeezed = lambda t: " ".join(t.split())  # noqa: E731  # equal texts but for white space: either may stay
    got = corpus_pipeline.run(spark, folder).collect()
    assert all(r["n_tokens"] == len(r["ids"]) for r in got)
    assert Counter((r["doc_id"], squeezed(tok.decode(r["ids"], skip_special_tokens=False))) for r in got) == Counter((i, squeezed(t)) for i, t in found)
