"""Parameter sweeps whose results are kept and taken up again."""

from __future__ import annotations

import hashlib
import itertools
import json
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def grid(**values: Iterable) -> list[dict]:
    """All combinations, the last name varying fastest; a value that isn't a list is fixed."""
    lists = [v if isinstance(v, (list, tuple, range)) else [v] for v in values.values()]
    return [dict(zip(values, c, strict=True)) for c in itertools.product(*lists)]


def sweep(spark: SparkSession, folder: str, run: Callable[..., DataFrame], combinations: list[dict]) -> DataFrame:
    """The rows of run(spark, **parameters) for each combination, with the parameters as columns.

    Each combination's rows are a table below ``folder``, named by a digest of its parameters; finished ones aren't
    run again, and one that was cut off has no commit marker and is written anew.
    """
    out = []
    hadoop = spark._jvm.org.apache.hadoop.fs
    for parameters in combinations:
        name = hashlib.md5(json.dumps(parameters, sort_keys=True, default=str).encode()).hexdigest()
        place = f"{folder.rstrip('/')}/{name}"
        done = hadoop.Path(f"{place}/_SUCCESS")
        if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
            run(spark, **parameters).write.mode("overwrite").parquet(place)
        out.append(spark.read.parquet(place).withColumns({k: F.lit(v) for k, v in parameters.items()}))
    if not out:
        raise ValueError("a sweep needs a combination")
    first, *rest = out
    for df in rest:
        first = first.unionByName(df)
    return first
