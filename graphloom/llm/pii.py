"""Personal data by weak supervision.

Candidates are spans of the base patterns and of looser ones. Labelers (strict pattern, gazetteers, context words, what
stands at the borders, checksums) vote +1 or -1 on each, or abstain. Expectation-maximisation over all vote patterns of the corpus
estimates each labeler's reliability and each pattern's probability; these train a logistic span classifier that also
sees what a span looks like (its signs, digits, separators and borders, by kind), and it decides on the loose
candidates. Base spans always stay. All matching is linear in the text.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

KINDS = ("email", "ip", "card", "phone")
LABELERS = ("strict", "gazetteer", "context", "border", "structure")
#: Probability from which a loose span is personal data.
DECIDE = 0.9
#: Characters before a span in which context words are looked for.
CONTEXT = 40

#: The base patterns.
BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOOSE = {
    "email": r"[A-Za-z0-9._%+-]+\s?(?:\[at\]|\(at\)|\{at\})\s?[A-Za-z0-9-]+(?:\s?(?:\[dot\]|\(dot\)|\{dot\}|\.)\s?[A-Za-z0-9-]+)+",
    "ip": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "phone": r"(?<![0-9+])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
}
#: Gazetteers.
DOMAINS = frozenset("com org net edu gov io de fr es uk it info eu ch at be nl us ca".split())
CARD_STARTS = re.compile(r"4|5[1-5]|2[2-7]|3[47]|6011|65")
CONTEXT_WORDS = {
    "email": frozenset("email e-mail mail contact correo courriel kontakt write reach".split()),
    "ip": frozenset("ip address host server login client dirección adresse".split()),
    "card": frozenset("card credit visa mastercard amex payment tarjeta carte karte".split()),
    "phone": frozenset("phone tel telephone call mobile fax cell teléfono téléphone telefon".split()),
}
AGAINST_WORDS = frozenset("version isbn issn order invoice sku serial token hash sha md5 id no nr página page".split())


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = 2 * d - 9 if d > 4 else 2 * d
        total += d
    return total % 10 == 0


_DIGIT = re.compile("[0-9]")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_HOST = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
# a run of digits that fails from its beginning fails from everywhere in it
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD, _PHONE = re.compile(BASE["card"]), re.compile(BASE["phone"])
_AT = re.compile(r"\s?(?:\[at\]|\(at\)|\{at\})\s?[A-Za-z0-9-]++(?:\s?(?:\[dot\]|\(dot\)|\{dot\}|\.)\s?[A-Za-z0-9-]++)+")
_LOOSE_IP, _LOOSE_PHONE = re.compile(LOOSE["ip"]), re.compile(LOOSE["phone"])


def _local_start(text: str, end: int, floor: int) -> int:
    """Where the local part that ends at ``end`` begins, not before ``floor``."""
    at, step = end, 64
    while True:
        begin = max(floor, end - step)
        found = _LOCAL.search(text[begin:end])
        at = begin + found.start() if found else end
        if at > begin or begin == floor:
            return at
        step *= 4


def _mails(text: str, sign: str, pattern: re.Pattern) -> list[tuple[str, int, int]]:
    """Leftmost non-overlapping addresses: a local part before each match of ``pattern``."""
    out, floor = [], 0
    if sign not in text:
        return out
    for m in pattern.finditer(text):
        start = _local_start(text, m.start(), floor)
        if start < m.start():
            out.append(("email", start, m.end()))
            floor = m.end()
    return out


def _digits(span: str) -> str:
    return span.replace(" ", "").replace("-", "")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by kind as listed, then start."""
    out = _mails(text, "@", _HOST)
    if not _DIGIT.search(text):
        return out
    if text.count(".") >= 3:
        out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m.group().split("."))]
    for m in _CARD.finditer(text):
        digits = _digits(m.group())
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m.group()) <= 15]
    return out


def loose_spans(text: str) -> list[tuple[str, int, int]]:
    out = _mails(text, "at", _AT) if any(x in text for x in ("[at]", "(at)", "{at}")) else []
    if _DIGIT.search(text):
        if text.count(":") >= 7:
            out += [("ip", m.start(), m.end()) for m in _LOOSE_IP.finditer(text)]
        out += [("phone", m.start(), m.end()) for m in _LOOSE_PHONE.finditer(text)]
        for m in _CARD.finditer(text):
            digits = _digits(m.group())
            if 14 <= len(digits) <= 16 and not luhn(digits):
                out.append(("card", m.start(), m.end()))
    return out


def shape(text: str, start: int, end: int) -> str:
    """What a span looks like, in a bounded number of values: digits, separators, letters, first sign, borders."""
    span = text[start:end]
    digits = sum(c.isdigit() for c in span)
    marks = [c for c in span if not c.isalnum()]
    side = lambda c: "n" if not c else "s" if c.isspace() else "d" if c.isdigit() else "a" if c.isalpha() else c if c in ".,:;+-/#()" else "o"
    few = "0" if not digits else "1" if digits < 9 else "2" if digits < 12 else "3" if digits < 14 else "4" if digits < 17 else "5"
    return "".join((few, str(min(3, len(marks))), str(min(2, len(set(marks)))), "a" if any(c.isalpha() for c in span) else "-", "+" if span[:1] == "+" else "(" if span[:1] == "(" else "x", "1" if digits > 3 and len({c for c in span if c.isdigit()}) < 3 else "0", side(text[start - 1 : start] if start else ""), side(text[end : end + 1])))


def votes(text: str, kind: str, start: int, end: int, strict: bool) -> tuple[int, ...]:
    """One vote of each labeler."""
    span, before, after = text[start:end], text[max(0, start - CONTEXT) : start], text[end : end + 1]
    digits = re.sub("[^0-9]", "", span)
    if kind == "email":
        known = 1 if re.split(r"[.\])}\s]+", span.lower())[-1] in DOMAINS else -1
        structure = 1 if re.match(r"[A-Za-z0-9]", span) and ".." not in span else -1
    elif kind == "ip":
        first = digits[:1]
        known = 0 if ":" in span else (-1 if first == "0" or span.split(".")[0] in ("0", "255") else 1)
        structure = 1 if ":" in span or all(x == "0" or not x.startswith("0") for x in span.split(".")) else -1
    elif kind == "card":
        known = 1 if CARD_STARTS.match(digits) else -1
        structure = 1 if luhn(digits) else -1
    else:
        known = 1 if span.startswith("+") else 0
        structure = 1 if 10 <= len(digits) <= 13 else -1
    words = re.findall(r"[^\W_]+(?:-[^\W_]+)*", before.lower())
    context = 1 if CONTEXT_WORDS[kind].intersection(words) else (-1 if AGAINST_WORDS.intersection(words[-2:]) else 0)
    border = -1 if (before[-1:].isalnum() or after.isalnum()) else 1
    return (int(strict), known, context, border, structure)


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    span = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("strict", pa.bool_()), ("votes", pa.string()), ("shape", pa.string())])
    for batch in batches:
        rows = []
        for text in batch.column(1).to_pylist():
            base = base_spans(text)
            loose = sorted(loose_spans(text), key=lambda x: (x[1], -x[2]))
            found = [(k, s, e, True) for k, s, e in base]
            if loose:  # those that overlap no base span and no earlier loose one
                taken = sorted((s, e) for _, s, e in base)
                starts, reach, furthest = [s for s, _ in taken], [], 0
                for _, e in taken:
                    furthest = max(furthest, e)
                    reach.append(furthest)
                last = 0
                for k, s, e in loose:
                    before = bisect.bisect_left(starts, e)  # base spans that begin before e
                    if s >= last and not (before and reach[before - 1] > s):
                        found.append((k, s, e, False))
                        last = e
            rows.append([{"kind": k, "start": s, "end": e, "strict": strict, "votes": ",".join(map(str, votes(text, k, s, e, strict))), "shape": shape(text, s, e)} for k, s, e, strict in found])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(span))], names=["doc_id", "spans"])


def label_model(patterns: list[tuple[str, tuple[int, ...]]], counts: list[int], rounds: int = 50) -> dict[tuple[str, tuple[int, ...]], float]:
    """P(personal data) of each (kind, votes), by EM for labelers of their own accuracy in each kind and class."""
    out: dict[tuple[str, tuple[int, ...]], float] = {}
    for kind in sorted({k for k, _ in patterns}):
        own = [(v, c) for (k, v), c in zip(patterns, counts, strict=True) if k == kind]
        v = np.array([x for x, _ in own])
        n = np.array([c for _, c in own], float)
        p = 1 / (1 + np.exp(-v.sum(1).astype(float)))  # majority to begin with
        for _ in range(rounds):
            prior = np.clip(((p * n).sum() + 1) / (n.sum() + 2), 0.01, 0.99)
            ll = np.full(len(v), np.log(prior / (1 - prior)))
            voted = (v != 0).astype(float)
            all_yes, all_no = ((voted * (q * n)[:, None]).sum(0) + 2 for q in (p, 1 - p))
            for value in (-1, 1):  # who abstains says nothing
                hit = (v == value).astype(float)
                yes = (hit * (p * n)[:, None]).sum(0) + 1
                no = (hit * ((1 - p) * n)[:, None]).sum(0) + 1
                ll += (hit * np.log((yes / all_yes) / (no / all_no))).sum(1)
            p = 1 / (1 + np.exp(-np.clip(ll, -30, 30)))
        if (p * n * v.sum(1)).sum() / max(1e-9, (p * n).sum()) < ((1 - p) * n * v.sum(1)).sum() / max(1e-9, ((1 - p) * n).sum()):
            p = 1 - p  # the class with more support is the positive one
        out |= {(kind, tuple(x)): float(y) for (x, _), y in zip(own, p, strict=True)}
    return out


Key = tuple[str, tuple[int, ...], str]


def _features(key: Key) -> dict[str, float]:
    """Features of a span: its votes but that of the strict pattern, and its looks, each by itself and by kind."""
    kind, given, look = key
    out = {f"kind {kind}": 1.0}
    for name, value in zip(LABELERS[1:], given[1:], strict=True):
        if value:
            out[f"{name} {value}"] = out[f"{kind} {name} {value}"] = 1.0
    for k, value in enumerate(look):
        out[f"look {k} {value}"] = out[f"{kind} look {k} {value}"] = 1.0
    return out


def span_classifier(soft: dict[tuple[str, tuple[int, ...]], float], counts: dict[Key, int], rounds: int = 30) -> dict[Key, float]:
    """A logistic regression on what spans look like and their votes, trained on the label model's probabilities; its value for each key.

    The vote of the strict pattern isn't a feature: a loose span that looks like base spans is judged like them.
    """
    keys = sorted(counts)
    if not keys:
        return {}
    found = [_features(k) for k in keys]
    names = {x: k for k, x in enumerate(sorted({x for f in found for x in f}))}
    x = np.zeros((len(keys), len(names) + 1))
    x[:, -1] = 1.0
    for row, f in enumerate(found):
        x[row, [names[k] for k in f]] = [*f.values()]
    y = np.array([soft[k[:2]] for k in keys])
    n = np.array([np.log1p(counts[k]) for k in keys])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (n * p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (n * (p - y)) + 0.1 * w)
        w -= step * min(1.0, 4.0 / (np.abs(step).max() + 1e-12))
    p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
    return dict(zip(keys, map(float, p), strict=True))


def _decide(classifier: dict[Key, float]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()), ("score", pa.float64())])
        for batch in batches:
            rows = []
            for spans in batch.column(1).to_pylist():
                found = []
                for s in spans or []:
                    score = classifier.get((s["kind"], tuple(map(int, s["votes"].split(","))), s["shape"]), 0.0)
                    if s["strict"] or score >= DECIDE:
                        found.append({"kind": s["kind"], "start": s["start"], "end": s["end"], "base": s["strict"], "score": score})
                rows.append(sorted(found, key=lambda s: (KINDS.index(s["kind"]), s["start"])))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(span))], names=["doc_id", "spans"])

    return run


def find_pii(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id and spans (kind, start, end, base, score), by kind as listed and start.

    Offsets are code points, ends exclusive. Null and empty texts have no spans. Spans of different kinds may overlap
    among the base spans; added ones overlap nothing. Repeated rows are judged alike. What reaches the driver is one
    count for each pattern of votes and looks that occurs, whose values are bounded whatever the texts. Columns other
    than doc_id and text are ignored, whatever their names; an empty table gives an empty result.
    """
    spans = "array<struct<kind:string,start:int,end:int,strict:boolean,votes:string,shape:string>>"
    found = common.materialize(common.documents(docs).mapInArrow(_candidates, f"doc_id long, spans {spans}"))
    rows = found.select(F.explode("spans").alias("s")).groupBy("s.kind", "s.votes", "s.shape").agg(F.count("*").alias("n")).collect()
    counts = {(r["kind"], tuple(map(int, r["votes"].split(","))), r["shape"]): r["n"] for r in rows}
    patterns: dict[tuple[str, tuple[int, ...]], int] = {}
    for key, n in counts.items():
        patterns[key[:2]] = patterns.get(key[:2], 0) + n
    keys = sorted(patterns)
    soft = label_model(keys, [patterns[k] for k in keys])
    return found.mapInArrow(_decide(span_classifier(soft, counts)), "doc_id long, spans array<struct<kind:string,start:int,end:int,base:boolean,score:double>>")


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts, digests, alls = [], [], []
        for spans in batch.column(1).to_pylist():
            named = [(s["base"], s["kind"], f"{s['kind']}:{s['start']}:{s['end']}") for s in spans]
            counts.append([sum(base and kind == k for base, kind, _ in named) for k in KINDS])
            digests.append(hashlib.sha256(",".join(x for base, _, x in named if base).encode()).hexdigest())
            alls.append(",".join(x for _, _, x in named))
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([c[k] for c in counts], pa.int64()) for k in range(4)), pa.array(digests, pa.string()), pa.array(alls, pa.string())], names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(common.table(spark, sf_dir, "documents"))
    return found.mapInArrow(_digest, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
