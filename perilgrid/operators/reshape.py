"""Shapes of tables: long and wide, one-hot, nested, composite keys, picks per group, comparisons."""

from __future__ import annotations

import hashlib
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def wide(frame: DataFrame, by: str, name: str, values: list, value: str) -> DataFrame:
    """Long to wide: a column for each of the given values of name, so that they aren't searched for."""
    return frame.groupBy(by).pivot(name, values).agg(F.max(value))


def long(frame: DataFrame, by: list[str], columns: list[str], name: str, value: str) -> DataFrame:
    """Wide to long: a row for each of the columns."""
    return frame.unpivot(by, columns, name, value)


def one_hot(frame: DataFrame, c: str, values: list) -> DataFrame:
    """frame with a column c_value of 0 and 1 for each value."""
    return frame.select("*", *((F.col(c) == F.lit(v)).cast("int").alias(f"{c}_{v}") for v in values))


def compose(*parts: Column | str, separator: str = "|") -> Column:
    """A composite key."""
    return F.concat_ws(separator, *(F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts))


def part_of(key: Column | str, i: int, separator: str = "|") -> Column:
    """Part i of a composite key, null if it has none."""
    quoted = "\\Q" + separator + "\\E"
    return F.get(F.split(key, quoted), F.lit(i))


def to_members(groups: DataFrame, units: DataFrame, group: str = "grp", unit: str = "unit") -> DataFrame:
    """The rows of groups(grp, ...) for each member of units(unit), whose key begins with its group's."""
    members = units.select(unit, part_of(unit, 0).alias(group))
    return members.join(groups, group)


def nested(frame: DataFrame, by: list[str], order: str, columns: list[str]) -> DataFrame:
    """One row per group with an array for each column, all in the same order."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("_o"), *columns)))
    g = frame.groupBy(*by).agg(rows.alias("_x"))
    field = lambda c: F.transform("_x", lambda x: x[c]).alias(c)
    return g.select(*by, *map(field, columns))


def at_or(values: Column | str, i: Column, default: float = 0.0) -> Column:
    """The value at a computed place from 0 on, or the default beyond the ends."""
    return F.coalesce(F.get(values, i.cast("int")), F.lit(default))


def folded_sum(a: str, b: str) -> Column:
    """The sum of products of two arrays, in their order."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))


def one_per_group(frame: DataFrame, group: str, unit: str) -> DataFrame:
    """The rows of each group's first unit."""
    first = frame.groupBy(group).agg(F.min(unit).alias(unit))
    return frame.join(first, [group, unit], "left_semi")


def every_nth(frame: DataFrame, by: list[str], order: str, n: int, first: int | None = None) -> DataFrame:
    """Of each group, sorted, the rows 0, n, 2n, ...; of these the first few if asked."""
    k = F.row_number().over(Window.partitionBy(*by).orderBy(order)) - 1
    d = frame.withColumn("_k", k).where(F.col("_k") % n == 0)
    return (d.where(F.col("_k") < first * n) if first else d).drop("_k")


def largest_by_name(frame: DataFrame, name: str, size: str, tie: str) -> DataFrame:
    """Of rows with the same name the largest, ties to the smallest ``tie``."""
    rest = [c for c in frame.columns if c != name]
    top = frame.groupBy(name).agg(F.min_by(F.struct(*rest), F.struct(-F.col(size), F.col(tie))).alias("_x"))
    return top.select(name, *(F.col(f"_x.{c}").alias(c) for c in rest)).select(*frame.columns)


def sorted_set(frame: DataFrame, by: list[str], c: str) -> DataFrame:
    """(by, values): the distinct values of c, sorted."""
    return frame.groupBy(*by).agg(F.array_sort(F.collect_set(c)).alias("values"))


def prefixes(frame: DataFrame, pos: str, sizes: tuple[int, ...]) -> DataFrame:
    """frame's rows for each k of sizes, as far as pos is below k."""
    ks = F.filter(F.array(*map(F.lit, sizes)), lambda k: F.col(pos) < k)
    return frame.select("*", F.explode(ks).alias("k"))


def days(first: Column, last: Column) -> Column:
    """All midnights from the day of one timestamp to that of another."""
    return F.sequence(F.date_trunc("day", first), F.date_trunc("day", last), F.expr("interval 1 day"))


def compared(a: DataFrame, b: DataFrame, on: list[str], value: str, tolerance: float = 1e-6) -> DataFrame:
    """(on, a, b, close): values of two tables side by side; close: equal up to the tolerance, relative
    above 1. A row that only one has isn't close."""
    j = a.select(*on, F.col(value).alias("a")).join(b.select(*on, F.col(value).alias("b")), on, "full")
    close = F.abs(F.col("a") - F.col("b")) <= tolerance * F.greatest(F.lit(1.0), F.abs("b"))
    return j.withColumn("close", F.coalesce(close, F.lit(False)))


def consistent(joined: DataFrame, a: str, b: str, most: float = 1e-6) -> DataFrame:
    """The same rows; reading one whose a and b differ by ``most`` or more is an error."""
    ok = F.abs(F.col(a) - F.col(b)) < most
    return joined.withColumn(a, F.when(ok, F.col(a)).otherwise(F.raise_error(F.concat(F.lit(f"{a} and {b} differ: "), F.col(a).cast("string"), F.lit(", "), F.col(b).cast("string"))).cast("double")))


def signed(c: Column, digits: int = 2, p: Column | None = None) -> Column:
    """A number with its sign and, by its p-value, one to three stars."""
    text = F.format_string(f"%+.{digits}f", c.cast("double"))
    if p is None:
        return text
    return F.concat(text, F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise(""))


def best_variant(frame: DataFrame, by: list[str], variant: str, value: str) -> DataFrame:
    """(by, variant, value): the least value over the variants."""
    return frame.groupBy(*by).agg(F.min_by(variant, F.struct(value, variant)).alias(variant), F.min(value).alias(value))


def report(runs: DataFrame, run: str, names: list[str], on: list[str], value: str) -> DataFrame:
    """(on, a column for each run, change): runs side by side, the last less the first."""
    return runs.groupBy(*on).pivot(run, names).agg(F.max(value)).withColumn("change", F.col(names[-1]) - F.col(names[0]))


def code_md5(*files: str) -> str:
    """The MD5 of source files, by which a result names the code that made it."""
    h = hashlib.md5(usedforsecurity=False)
    for f in files:
        h.update(Path(f).read_bytes())
    return h.hexdigest()


def written_once(spark: SparkSession, path: str, make) -> DataFrame:
    """The table at path; where there is none yet, make() is written there first."""
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def only_missing(spark: SparkSession, path: str, asked: DataFrame, on: list[str], make) -> DataFrame:
    """The rows for asked(on) of the key-value table at path; keys that it lacks, without rows of
    their own too, are made by make(missing keys) and appended first. Keys are listed beside it."""
    keys = asked.select(*on).distinct()
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/keys/_SUCCESS")
    there = fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs_path)
    missing = keys.join(spark.read.parquet(f"{path}/keys"), on, "left_anti") if there else keys
    if missing.take(1):
        made = make(missing)
        made.write.mode("append").parquet(f"{path}/rows")
        missing.write.mode("append").parquet(f"{path}/keys")
    return spark.read.parquet(f"{path}/rows").join(keys, on, "left_semi")
