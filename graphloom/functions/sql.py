"""The expressions as functions of SQL: temporary functions with a body, which the optimizer puts into the plan."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: name -> (parameters, type, body). Bodies are expressions, so no call leaves the JVM.
FUNCTIONS = {
    "loom_dot": ("a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "DOUBLE", "aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x)"),
    "loom_l2_squared": ("a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "DOUBLE", "aggregate(zip_with(a, b, (x, y) -> (x - y) * (x - y)), 0D, (s, x) -> s + x)"),
    "loom_norm": ("a ARRAY<DOUBLE>", "DOUBLE", "sqrt(aggregate(a, 0D, (s, x) -> s + x * x))"),
    "loom_cosine": ("a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "DOUBLE", "coalesce(loom_dot(a, b) / nullif(loom_norm(a) * loom_norm(b), 0D), 0D)"),
    "loom_sigmoid": ("x DOUBLE", "DOUBLE", "1 / (1 + exp(-x))"),
    "loom_decay": ("value DOUBLE, age DOUBLE, rate DOUBLE", "DOUBLE", "value * exp(-rate * age)"),
    "loom_uniform": ("seed STRING, key STRING", "DOUBLE", "cast(conv(substring(md5(cast(concat(seed, ':', key) AS BINARY)), 1, 8), 16, 10) AS BIGINT) / 4294967296D"),
    "loom_edge_index": ("u BIGINT, v BIGINT, n BIGINT", "BIGINT", "least(u, v) * n + greatest(u, v)"),
    "loom_skipgrams": (
        "path ARRAY<BIGINT>, reach INT",
        "ARRAY<STRUCT<target: BIGINT, context: BIGINT>>",
        "flatten(transform(path, (x, k) -> transform(concat(slice(path, greatest(k - reach, 0) + 1, least(k, reach)), slice(path, k + 2, reach)), y -> named_struct('target', x, 'context', y))))",
    ),
}


def register(spark: SparkSession) -> list[str]:
    """Makes FUNCTIONS known to ``spark.sql`` for the session; their names. Doing it again changes nothing."""
    for name, (parameters, kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")
    return list(FUNCTIONS)
