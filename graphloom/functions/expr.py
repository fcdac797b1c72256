"""Column expressions: vectors, digests, uniforms and a jump-ahead generator."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def squared_l2(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 where either norm is 0."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(0.0)


def uniform(seed: int | str, *keys: Column) -> Column:
    """[0, 1) from the first 32 bits of a digest; equal in any SQL engine with md5."""
    text = F.concat_ws(":", F.lit(str(seed)), *[k.cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def lcg(i: Column, seed: int, a: int, c: int, m: int, bits: int = 31) -> Column:
    """The i-th value of x -> (a x + c) mod m from ``seed`` by squaring the affine map; m < 2^31."""
    start = F.struct(F.lit(1).cast("bigint").alias("p"), F.lit(0).cast("bigint").alias("q"), F.lit(a % m).cast("bigint").alias("a"), F.lit(c % m).cast("bigint").alias("c"), i.cast("bigint").alias("n"))

    def step(s: Column, _: Column) -> Column:
        odd = s.n % 2 == 1
        return F.struct(
            F.when(odd, s.p * s.a % m).otherwise(s.p).alias("p"),
            F.when(odd, (s.a * s.q + s.c) % m).otherwise(s.q).alias("q"),
            (s.a * s.a % m).alias("a"),
            ((s.a * s.c + s.c) % m).alias("c"),
            F.floor(s.n / 2).cast("bigint").alias("n"),
        )

    return F.aggregate(F.sequence(F.lit(1), F.lit(bits)), start, step, lambda s: (s.p * F.lit(seed % m) + s.q) % m)


def safe_log2(x: Column) -> Column:
    """Minus infinity at 0 and below."""
    return F.when(x > 0, F.log2(x)).otherwise(F.lit(float("-inf")))


def mod_power(base: Column, exponent: Column, m: int, bits: int = 31) -> Column:
    """base^exponent mod m by squaring; m < 2^31."""
    start = F.struct(F.lit(1 % m).cast("bigint").alias("r"), (base.cast("bigint") % m).alias("b"), exponent.cast("bigint").alias("e"))
    step = lambda s, _: F.struct(F.when(s.e % 2 == 1, s.r * s.b % m).otherwise(s.r).alias("r"), (s.b * s.b % m).alias("b"), F.floor(s.e / 2).cast("bigint").alias("e"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(bits)), start, step, lambda s: s.r)


def mod_inverse(x: Column, prime: int) -> Column:
    """The inverse modulo a prime below 2^31."""
    return mod_power(x, F.lit(prime - 2), prime)


def sorted_json(m: Column) -> Column:
    """A map as JSON with its keys in order."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(m))))


def edge_index(u: Column, v: Column, n: Column | int) -> Column:
    """A number for an undirected edge among n vertices."""
    return F.least(u, v) * n + F.greatest(u, v)


def all_close_to_zero(v: Column, limit: float = 1e-8) -> Column:
    return F.coalesce(F.array_max(F.transform(v, F.abs)), F.lit(0.0)) <= limit


def expand_nodes(text: Column) -> Column:
    """The host names of a list such as ``n[03,10-12]``; a text without brackets is one name."""
    items = F.split(F.regexp_extract(text, r"\[([^\]]*)\]", 1), ",")

    def item(x: Column) -> Column:
        first, last = F.split(x, "-")[0], F.element_at(F.split(x, "-"), -1)
        return F.transform(F.sequence(first.cast("int"), last.cast("int")), lambda k: F.lpad(k.cast("string"), F.greatest(F.length(first), F.length(k.cast("string"))), F.lit("0")))

    names = F.transform(F.flatten(F.transform(items, item)), lambda k: F.concat(F.regexp_extract(text, r"^([^\[]*)", 1), k, F.regexp_extract(text, r"\](.*)$", 1)))
    return F.when(text.contains("["), names).otherwise(F.array(text))
