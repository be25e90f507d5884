"""Control over what the optimizer may merge."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fenced(df: DataFrame, *computed: str) -> DataFrame:
    """``df`` with its ``computed`` columns behind a generator, through which nothing is merged.

    The optimizer writes the expressions of one projection into those of the next.  Where a value
    is used many times at several levels, as box corners are, the merged expression grows
    exponentially and no longer compiles.  All other columns pass by and can still be pruned.
    """
    packed = F.explode(F.array(F.struct(*computed))).alias("_one")
    return df.select(*[c for c in df.columns if c not in computed], packed).select(*[f"_one.{c}" if c in computed else c for c in df.columns])
