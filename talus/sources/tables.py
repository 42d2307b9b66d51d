"""Readers and writers: polymorphic JSON, aliased CSV, split and partitioned sinks, resumable runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talus.functions import text


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_json_records(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """(file, ordinal, record) of JSON files that hold a list, an object with a list in it, or one record.

    Of an object's lists that under faculty counts, else that under awards, else the first one. Files that are no JSON give none.
    """
    # as text: the order of an object's fields counts
    reader = spark.read.option("wholetext", True)
    if recursive:
        reader = reader.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json")
    raw = reader.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("file"), F.trim("value").alias("j"))
    raw = raw.select("path", "file", F.regexp_replace("j", r"^\s+", "").alias("j")).where(F.try_parse_json("j").isNotNull())
    kind = "array<string>"
    whole = F.from_json("j", "map<string,string>")
    is_list = lambda x: x.startswith("[") & F.from_json(x, kind).isNotNull()
    lists = F.filter(F.array(whole["faculty"], whole["awards"]), is_list)
    first = F.coalesce(F.get(lists, F.lit(0)), F.get(F.filter(F.map_values(whole), is_list), F.lit(0)))
    listed = F.when(F.col("j").startswith("["), F.from_json("j", kind)).otherwise(F.from_json(first, kind))
    return raw.select("path", "file", F.posexplode(F.coalesce(listed, F.array("j"))).alias("ordinal", "record")).select("file", "ordinal", "record", "path")


def without_twins(records: DataFrame, mark: str = "_enriched") -> DataFrame:
    """Records (file, ...) without those of files that have a twin whose name ends in mark."""
    stem = F.regexp_replace("file", f"({mark})?[.]json$", "")
    twin = records.where(F.col("file").endswith(f"{mark}.json")).select(stem.alias("stem")).distinct()
    keyed = records.withColumn("stem", stem)
    return keyed.where(F.col("file").endswith(f"{mark}.json")).unionByName(keyed.where(~F.col("file").endswith(f"{mark}.json")).join(twin, "stem", "left_anti").select(*keyed.columns)).drop("stem")


def read_years(spark: SparkSession, path: str, years: list[int]) -> DataFrame:
    """Records below a folder of each year; where there is none of these, those of the folder's own files."""
    every = read_json_records(spark, path, recursive=True)
    of_year = every.where(F.col("path").rlike("/(?:" + "|".join(map(str, years)) + ")/"))
    return every.where(~F.col("path").rlike("/[0-9]{4}/")) if of_year.isEmpty() else of_year


def list_or_text(record: Column, field: str) -> Column:
    """A field that holds a list of strings or one string, as a list; a missing or empty one is an empty list."""
    raw = F.get_json_object(record, f"$.{field}")
    many = F.from_json(raw, "array<string>")
    return F.when(raw.startswith("["), many).when(F.coalesce(raw, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.array(raw))


def whole_number(c: Column) -> Column:
    """An integer from 12, '12', '12.0'; null for '' and anything else."""
    return c.cast("string").try_cast("double").try_cast("int")


def read_aliased_csv(spark: SparkSession, path: str, aliases: dict[str, list[str]], required: list[str]) -> DataFrame:
    """A header CSV of strings with each column under any of its aliases; rows without a required value go."""
    raw = spark.read.csv(path, header=True, multiLine=True, escape='"')
    cols = []
    for name, others in aliases.items():
        there = [F.nullif(F.trim(F.col(f"`{c}`")), F.lit("")) for c in [name, *others] if c in raw.columns]
        cols.append((F.coalesce(*there) if there else F.lit(None).cast("string")).alias(name))
    return raw.select(*cols).dropna(subset=required)


def write_split(df: DataFrame, path: str, by: str) -> None:
    """One folder for each value of a column."""
    df.repartition(by).write.mode("overwrite").partitionBy(by).parquet(path)


def write_text(df: DataFrame, path: str, suffix: str) -> None:
    """One text file of a few lines (value) whose name ends in suffix."""
    spark = df.sparkSession
    df.coalesce(1).write.mode("overwrite").text(path)
    jvm = spark._jvm.org.apache.hadoop.fs.Path
    files = jvm(path).getFileSystem(spark._jsc.hadoopConfiguration())
    for f in files.listStatus(jvm(path)):
        name = f.getPath().getName()
        if name.startswith("part-"):
            files.rename(f.getPath(), jvm(f"{path}/{name.rsplit('.', 1)[0]}{suffix}"))


def write_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    df.select(*columns).write.mode("overwrite").csv(path, header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def write_statuses(df: DataFrame, path: str, status: str) -> dict[str, str]:
    """Three tables: all rows, those that need no review, those that do. The rows are written once and read for the other two."""
    out = {k: f"{path}/{k}" for k in ("full", "display", "review")}
    df.write.mode("overwrite").parquet(out["full"])
    full = df.sparkSession.read.parquet(out["full"])
    review = F.coalesce(F.col(status), F.lit("")) == "needs_review"
    full.where(~review).write.mode("overwrite").parquet(out["display"])
    full.where(review).write.mode("overwrite").parquet(out["review"])
    return out


def write_by_slug(df: DataFrame, path: str, *by: str) -> None:
    """JSON in a folder for each value of the columns, named by their slugs."""
    slugs = {f"{c}_slug": text.slug(F.col(c), "_") for c in by}
    df.withColumns(slugs).repartition(*slugs).write.mode("overwrite").partitionBy(*slugs).json(path)


def write_export(df: DataFrame, path: str, columns: list[str], measures: dict[str, Column]) -> None:
    """Rows as JSON and CSV, and one row of measures about them."""
    df.write.mode("overwrite").json(f"{path}/rows")
    written = df.sparkSession.read.schema(df.schema).json(f"{path}/rows")
    write_csv(written, f"{path}/csv", columns)
    written.agg(*[m.alias(k) for k, m in measures.items()]).write.mode("overwrite").json(f"{path}/metadata")


def report(df: DataFrame, title: str, by: str, most: int = 15) -> list[str]:
    """Lines of a text report: the rows of each value of a column, the most frequent first, and their sum."""
    n = df.groupBy(by).count().orderBy(F.col("count").desc(), by)
    total = df.count()
    lines = [f"# {title}", "", f"**Total:** {total}", ""]
    return lines + [f"- {'none' if r[by] is None else r[by]}: {r['count']} ({100 * r['count'] / max(total, 1):.1f}%)" for r in n.limit(most).collect()]


def parse_report(lines: DataFrame) -> DataFrame:
    """(label, n) of the counters in a report's lines (value); the sum as Total."""
    label = F.coalesce(F.nullif(F.regexp_extract("value", r"^- (.*): \d+ \(", 1), F.lit("")), F.when(F.col("value").startswith("**Total:**"), "Total"))
    return lines.select(label.alias("label"), F.regexp_extract("value", r"(?:: |\*\* )(\d+)", 1).try_cast("long").alias("n")).where("label is not null and n is not null")


def split_failures(df: DataFrame, error: str) -> tuple[DataFrame, DataFrame]:
    """(rows without an error, dead letters)."""
    return df.where(F.col(error).isNull()).drop(error), df.where(F.col(error).isNotNull())


def unprocessed(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What a resumed run has left."""
    return rows.join(done.select(key), key, "left_anti")


def checked(df: DataFrame, condition: Column, least: float) -> DataFrame:
    """df itself if at least so large a share of its rows meets the condition; fails before anything is overwritten."""
    share = df.agg(F.avg(F.when(condition, 1.0).otherwise(0.0))).first()[0]
    if (share or 0.0) < least:
        raise ValueError(f"only {share} of the rows are valid")
    return df


def replace_table(df: DataFrame, path: str, condition: Column, least: float = 0.5) -> str | None:
    """Puts df in a table's place if enough of its rows are valid; the table that was there stays beside it. Returns where.

    The new table is written whole before anything moves, by the file system that the path names.
    """
    spark = df.sparkSession
    new, old = f"{path}-new", f"{path}-backup"
    checked(df, condition, least).write.mode("overwrite").parquet(new)
    jvm = spark._jvm.org.apache.hadoop.fs.Path
    files = jvm(path).getFileSystem(spark._jsc.hadoopConfiguration())
    had = files.exists(jvm(path))
    if had:
        files.delete(jvm(old), True)
        files.rename(jvm(path), jvm(old))
    files.rename(jvm(new), jvm(path))
    return old if had else None
