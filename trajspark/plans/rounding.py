"""Results that two engines can be compared by: doubles to a fixed number of digits, whole numbers as longs."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    out = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if kind in ("double", "float") or kind.startswith("decimal"):
            c = F.round(c.cast("double"), digits) + F.lit(0.0)
        elif kind in ("int", "smallint", "tinyint"):
            c = c.cast("long")
        out.append(c.alias(name))
    return df.select(*out)


def plain_zero(sql: str) -> str:
    """``sql`` with + 0.0 after every rounded result column: DuckDB rounds small negative numbers to -0.0, Spark to 0.0."""
    inner = r"(?:[^()]|\((?:[^()]|\((?:[^()]|\((?:[^()]|\([^()]*\))*\))*\))*\))*"
    return re.sub(rf"\bround\(({inner}), (\d)\) AS (\w+|\"\w+\")", r"(round(\1, \2) + 0.0) AS \3", sql)
