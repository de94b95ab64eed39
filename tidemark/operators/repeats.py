"""P5, Q6: repeated rows, found by digests.

Every row's 128-bit digest is counted (16 bytes a row move, pre-aggregated). Only rows whose digest
occurs more than once meet as whole rows, where they are compared exactly; all others stay where they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import boundary


def digest(df: DataFrame) -> list[Column]:
    """Two hashes of all cells and of which cells are missing; equal for rows that group together."""
    cells = [F.col(f"`{c}`") + 0.0 if t in ("double", "float") else F.col(f"`{c}`") for c, t in df.dtypes]
    missing = F.concat(F.lit(""), *[F.when(c.isNull(), "1").otherwise("0") for c in cells])
    return [F.xxhash64(F.lit(seed), missing, *cells).alias(name) for seed, name in ((1, "__d1"), (2, "__d2"))]


def repeated_digests(df: DataFrame) -> DataFrame:
    """Digests that occur more than once, and how often (``__n``)."""
    return df.select(*digest(df)).groupBy("__d1", "__d2").agg(F.count("*").alias("__n")).filter("__n > 1")


def repeated_rows(df: DataFrame) -> int:
    """Rows that equal an earlier one, by digest."""
    return repeated_digests(df).agg(F.sum(F.col("__n") - 1)).first()[0] or 0


def without_repeats(df: DataFrame) -> tuple[DataFrame, bool]:
    """(distinct rows, whether any went). ``df`` is read several times: give it a stage boundary first."""
    cols = df.columns
    again = boundary(repeated_digests(df), "repeats")
    if again.isEmpty():
        return df, False
    marked = df.select(*[F.col(f"`{c}`") for c in cols], *digest(df))
    keys = again.select("__d1", "__d2")
    # both joins broadcast the repeated digests when the written table is small
    some = marked.join(keys, ["__d1", "__d2"], "left_semi").select(*[F.col(f"`{c}`") for c in cols]).dropDuplicates()
    rest = marked.join(keys, ["__d1", "__d2"], "left_anti").select(*[F.col(f"`{c}`") for c in cols])
    return rest.unionByName(some), True
