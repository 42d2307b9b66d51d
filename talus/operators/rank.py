"""Top-k, keep-first, best record, pages, argmax and diversity."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talus.sources.scratch import stash


def top_k(df: DataFrame, k: int, *order: Column) -> DataFrame:
    """The first k rows in an order, with rank; the order should end in a unique column."""
    ranked = df.orderBy(*order).limit(k)
    return ranked.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def top_k_by(df: DataFrame, keys: list[str], k: int, *order: Column) -> DataFrame:
    """The first k rows of each key; the limit also applies before the shuffle."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)


def keep_first(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key by a stored order."""
    return top_k_by(df, keys, 1, *order).drop("rank")


def first_different(items: Column, key: str, k: int) -> Column:
    """The first k of a list of structs with different values of a field, those with null left out; for lists as short as one row's."""
    seen = lambda kept, x: x[key].isNull() | F.array_contains(kept[key], x[key])
    kept = F.aggregate(items, F.slice(items, 1, 0), lambda kept, x: F.when(seen(kept, x), kept).otherwise(F.concat(kept, F.array(x))))
    return F.slice(kept, 1, k)


def priority_union(sources: list[DataFrame], keys: list[str], order: str) -> DataFrame:
    """One row for each key: from the first source that has it, there the first by order."""
    both = None
    for k, s in enumerate(sources):
        s = s.withColumn("src_rank", F.lit(k))
        both = s if both is None else both.unionByName(s, allowMissingColumns=True)
    return keep_first(both, keys, F.col("src_rank"), F.col(order))


def left_preferred(left: DataFrame, right: DataFrame, key: str, order: str) -> DataFrame:
    """One row for each key that is not empty, with side: the left table's last row by order, or the right table's first where the left has none."""
    known = lambda df: df.where(F.coalesce(F.col(key), F.lit("")) != "")
    one = keep_first(known(left), [key], F.col(order).desc()).withColumn("side", F.lit("left"))
    two = keep_first(known(right), [key], F.col(order)).join(one.select(key), key, "left_anti").withColumn("side", F.lit("right"))
    return one.unionByName(two)


def filled(rows: DataFrame, column: str, sources: dict[str, DataFrame]) -> DataFrame:
    """rows (id, column) with source: a blank value is filled from the first of the sources (id, column; one row each) that has one; own where it was not blank."""
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    out = rows.select("id", F.when(~blank(column), F.col(column)).alias(column)).withColumn("source", F.when(F.col(column).isNotNull(), "own"))
    for name, table in sources.items():
        new = table.select("id", F.when(~blank(column), F.col(column)).alias("_new"))
        out = out.join(new, "id", "left").select("id", F.coalesce(column, "_new").alias(column), F.coalesce("source", F.when(F.col("_new").isNotNull(), name)).alias("source"))
    return out


def zipped(one: DataFrame, two: DataFrame, *orders: Column) -> DataFrame:
    """The n-th rows of two tables side by side, with nth from 1, each in its own stored order (one's, two's); raises for different lengths."""
    a, b = places(one, "nth", orders[0]), places(two, "nth", orders[1])
    n, m = a.count(), b.count()
    if n != m:
        raise ValueError(f"{n} rows beside {m}")
    return a.join(b, "nth")


def page(df: DataFrame, number: int, size: int, *order: Column) -> DataFrame:
    """One page with total_pages, page, show_start and show_end; the number is clamped to the pages there are."""
    n = df.count()
    pages = max(1, math.ceil(n / size))
    number = min(max(1, number), pages)
    at = (number - 1) * size
    rows = df.orderBy(*order).offset(at).limit(size)
    return rows.withColumns({"total_pages": F.lit(pages), "page": F.lit(number), "show_start": F.lit(at + 1 if n else 0), "show_end": F.lit(min(at + size, n))})


def top_phrases(rows: DataFrame, k: int = 36) -> DataFrame:
    """(phrase, n, rank): the k most frequent phrases of rows (id, first, second), equals by lower case; 4 to 120 characters long.

    Rows are taken in order of id, a whole number. Those of second count only as long as fewer than 2k different phrases have
    been seen before them: up to the place where the (2k)th different phrase comes for the first time.
    """
    one = lambda c, k: rows.select(F.explode(c).alias("phrase"), (2 * F.col("id") + k).alias("pos"))
    every = one("first", 0).unionByName(one("second", 1)).where(F.length("phrase").between(4, 120))
    seen = every.groupBy("phrase").agg(F.min("pos").alias("pos")).orderBy("pos").limit(2 * k).agg(F.count("*").alias("n"), F.max("pos").alias("upto")).first()
    if seen["n"] == 2 * k:
        every = every.where((F.col("pos") % 2 == 0) | (F.col("pos") <= seen["upto"]))
    return top_k(every.groupBy("phrase").agg(F.count("*").alias("n")), k, F.col("n").desc(), F.lower("phrase"), F.col("phrase"))


def best_of(array: str, score) -> Column:
    """The element of an array with the highest score; the first of equals; null where no score is above 0."""
    scored = F.transform(F.col(array), lambda x, i: F.struct(score(x).alias("s"), (-i).alias("i"), x.alias("x")))
    best = F.array_max(scored)
    return F.when(best["s"] > 0, best["x"])


def unique_ids(df: DataFrame, base: Column, *order: Column) -> DataFrame:
    """id: base, and -2, -3 and so on for later rows with the same base, in order.

    A base that ends in such a number itself may equal another row's id. Such rows are few; they get the next free number
    among the rows whose bases share the stem, one stem at a time.
    """
    stem = F.regexp_replace("_base", "(-[0-9]+)+$", "")
    out = df.withColumn("_base", base).withColumn("_stem", stem)
    twins = out.groupBy("_stem").agg(F.count_distinct("_base").alias("_k")).where("_k > 1").select("_stem")
    plain = out.join(twins, "_stem", "left_anti").withColumn("_n", F.row_number().over(Window.partitionBy("_base").orderBy(*order)))
    plain = plain.withColumn("id", F.when(F.col("_n") == 1, F.col("_base")).otherwise(F.concat_ws("-", "_base", F.col("_n")))).drop("_n")
    place = F.row_number().over(Window.partitionBy("_stem").orderBy(*order))
    rows = out.join(twins, "_stem", "left_semi").withColumn("_n", place)

    def name(t: pa.Table) -> pa.Table:
        taken, next_, ids = set(), {}, []
        for b in t.sort_by("_n")["_base"].to_pylist():
            one, k = b, next_.get(b, 2)
            while one in taken:
                one, k = f"{b}-{k}", k + 1
            next_[b] = k
            taken.add(one)
            ids.append(one)
        return t.sort_by("_n").select(["_stem", "_n"]).append_column("id", pa.array(ids, pa.string()))

    ids = rows.select("_stem", "_n", "_base").groupBy("_stem").applyInArrow(name, "_stem string, _n int, id string")
    twin = rows.join(ids, ["_stem", "_n"]).drop("_n")
    return plain.unionByName(twin).drop("_base", "_stem")


def within_budget(df: DataFrame, high: Column, cost: int, other_cost: int, budget: int, *order: Column) -> DataFrame:
    """The rows chosen under a budget of costs: all high ones, and of the others all but the last so many as the sum exceeds it by.

    order: the stored order, by which the others' end is cut.
    """
    tier = df.withColumn("_high", high)
    n, m = tier.agg(F.count_if(~F.col("_high")), F.count_if(F.col("_high"))).first()
    over = max(0, m * cost + n * other_cost - budget)
    # by places that are counted in ranges: a limit would bring all that stay to one task
    others = places(tier.where(~F.col("_high")), "_place", *order).where(F.col("_place") <= n - over).drop("_place")
    return tier.where("_high").unionByName(others).drop("_high")


def running_sum(df: DataFrame, value: str, key: str) -> DataFrame:
    """df with total: the sum of value over the rows up to each in order of a numeric key without repeats, null last.

    Rows are dealt by ranges of the key; only each range's sum comes to the driver, so no task sees all rows.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bounds = sorted(set(df.approxQuantile(key, [k / n for k in range(1, n)], 1 / (4 * n)))) if n > 1 else []
    below = F.filter(F.array(*map(F.lit, bounds)).cast("array<double>"), lambda b: b < F.col(key))
    dealt = df.withColumn("range_", F.when(F.col(key).isNull(), len(bounds) + 1).otherwise(F.size(below)))
    start, at = [], 0
    for r in sorted(dealt.groupBy("range_").agg(F.sum(value).alias("s")).collect()):
        start.append((r["range_"], at))
        at += r["s"] or 0
    start = df.sparkSession.createDataFrame(start, "range_ int, start long")
    w = Window.partitionBy("range_").orderBy(F.col(key).asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    summed = dealt.withColumn("total", F.sum(value).over(w)).join(F.broadcast(start), "range_")
    return summed.withColumn("total", F.col("total") + F.col("start")).drop("range_", "start")


def in_ranges(rows: DataFrame, value: str, ranges: DataFrame, low: str, high: str) -> DataFrame:
    """rows beside the ranges that their whole number value lies in, from low up to below high.

    Both sides meet by cells as wide as a range is on average, so this is a join on equal keys; a range is copied to each cell it touches.
    """
    some = ranges.where(F.col(low) < F.col(high))
    wide = max(1, int(some.agg(F.avg(F.col(high) - F.col(low))).first()[0] or 1))
    cell = lambda c: F.floor(c / wide).cast("long")
    cells = some.withColumn("_cell", F.explode(F.sequence(cell(F.col(low)), cell(F.col(high) - 1))))
    met = rows.withColumn("_cell", cell(F.col(value))).join(cells, "_cell")
    return met.where((F.col(value) >= F.col(low)) & (F.col(value) < F.col(high))).drop("_cell")


def places(df: DataFrame, to: str, *order: Column) -> DataFrame:
    """df with to: each row's place in an order, from 1. The order should end in a unique column.

    Rows are sorted by ranges; only the number of rows in each range comes to the driver, so no task sees all rows.
    """
    held = stash(df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()), "sorted")
    held = held.withColumn("_range", F.shiftright("_at", 33))
    counts = sorted((r["_range"], r["count"]) for r in held.groupBy("_range").count().collect())
    start, at = [], 0
    for r, n in counts:
        start.append((r, at))
        at += n
    begins = df.sparkSession.createDataFrame(start, "_range long, _start long")
    place = F.col("_start") + F.col("_at") - F.shiftleft("_range", 33) + 1
    return held.join(F.broadcast(begins), "_range").withColumn(to, place).drop("_at", "_range", "_start")


def mmr(pool: DataFrame, k: int, weight: float = 0.75) -> DataFrame:
    """Maximal marginal relevance for each query: pool (query_id, id, score 0..100, and vector or terms) -> query_id, id, rank.

    Alike is the cosine of two vectors, or the Jaccard of two lists of terms. pool should hold at most max(5k, 50) rows of a
    query; each step takes the first of equals by score, then place (if pool has one), then id. A query with at most k rows
    keeps their order by score.
    """
    what = "vector" if "vector" in pool.columns else "terms"
    pool = pool if "place" in pool.columns else pool.withColumn("place", F.lit(0))

    def likeness(values: list):
        if what == "vector":
            m = np.array([np.asarray(v, float) / (np.linalg.norm(v) or 1.0) for v in values])
            return lambda j: m @ m[j]
        sets = [set(v or ()) for v in values]
        return lambda j: np.array([len(s & sets[j]) / (len(s | sets[j]) or 1) for s in sets])

    def pick(t: pa.Table) -> pa.Table:
        rows = sorted(zip([-s for s in t["score"].to_pylist()], t["place"].to_pylist(), t["id"].to_pylist(), t[what].to_pylist(), strict=True), key=lambda r: r[:3])
        first = {i: (-s / 100, v) for s, _, i, v in reversed(rows)}
        ids = list(dict.fromkeys(r[2] for r in rows))
        rel, near, left, out = np.array([first[i][0] for i in ids]), np.zeros(len(ids)), list(range(len(ids))), []
        alike = likeness([first[i][1] for i in ids])
        while left and len(out) < k:
            value = weight * rel[left] - (1 - weight) * near[left]
            j = left.pop(int(np.argmax(np.round(value, 12)))) if len(ids) > k else left.pop(0)
            out.append(ids[j])
            near = np.maximum(near, alike(j))
        return pa.table({"query_id": pa.array([t["query_id"][0].as_py()] * len(out), pa.int64()), "id": pa.array(out, pa.int64()), "rank": pa.array(range(1, len(out) + 1), pa.int32())})

    return pool.select("query_id", "id", "score", "place", what).groupBy("query_id").applyInArrow(pick, "query_id long, id long, rank int")
