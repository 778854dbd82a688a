"""Row-wise helpers on DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def computed_once(df: DataFrame, row: Column, *kept: str) -> DataFrame:
    """``kept`` columns plus the fields of the struct ``row``, each computed once.

    The struct goes through a one-element generator. A later filter or projection then
    works on finished columns, where Spark would otherwise copy the defining expressions
    into it and evaluate them again.
    """
    return df.select(*kept, F.inline(F.array(row)))
