"""Counts of each choice's values under all other choices made, from a bitmap of row numbers for each value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talus.operators import rank

C, L = F.col, F.lit


def counts(rows: DataFrame, facets: dict[str, tuple[str, Column]], chosen: dict[str, Column]) -> DataFrame:
    """(facet, value, n): of each facet's values how many rows have them among those that go with every other facet's choice.

    facets: for each facet its column and which rows take part in it. chosen: for each choice made the rows that go with it; a
    facet is not narrowed by the choice of its own name, and values without a row are left out. Rows are numbered once. A bucket of
    32768 rows has a bitmap for each choice and each value; those of a value and of the other choices are intersected by an
    aggregate, so no expression grows with the number of values or choices.
    """
    flags = {f"_c_{k}": F.coalesce(v, L(False)) for k, v in chosen.items()} | {f"_f_{k}": F.coalesce(ok, L(False)) for k, (_, ok) in facets.items()}
    held = rank.places(rows.withColumns(flags), "_row", *[C(c) for c in rows.columns]).withColumn("bucket", F.bitmap_bucket_number("_row"))
    bit = F.bitmap_bit_position("_row")
    each = F.inline(F.array(*[F.struct(L(k).alias("facet"), C(c).cast("string").alias("value"), C(f"_f_{k}").alias("ok")) for k, (c, ok) in facets.items()]))
    values = held.select("bucket", bit.alias("bit"), each).where("ok").groupBy("bucket", "facet", "value").agg(F.bitmap_construct_agg("bit").alias("bits"))
    met = values
    if chosen:
        masks = held.groupBy("bucket").agg(*[F.bitmap_construct_agg(F.when(C(f"_c_{k}"), bit)).alias(f"m_{k}") for k in chosen])
        masks = masks.select("bucket", F.inline(F.array(*[F.struct(L(k).alias("choice"), C(f"m_{k}").alias("bits")) for k in chosen])))
        narrowed = values.select("bucket", "facet", "value").join(masks, "bucket").where("facet <> choice").drop("choice")
        met = values.unionByName(narrowed).groupBy("bucket", "facet", "value").agg(F.bitmap_and_agg("bits").alias("bits"))
    return met.groupBy("facet", "value").agg(F.sum(F.bitmap_count("bits")).alias("n")).where("n > 0")
