"""Keyed and append-only tables. All take and give DataFrames; a write is the caller's, as one atomic overwrite or append."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def first_of(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in ``order``, which must be total within a key."""
    return rows.withColumn("_k", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_k = 1").drop("_k")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], keep_first: tuple[str, ...] = ()) -> DataFrame:
    """New rows replace old ones by key; columns of ``keep_first`` keep the old value. Keys must be unique on each side."""
    rest = [c for c in old.columns if c not in keys]
    o, n = (df.select(*keys, F.struct(*rest).alias(side)) for df, side in ((old, "_o"), (new.select(*old.columns), "_n")))
    both = o.join(n, keys, "full")

    def pick(c):
        first, second = ("_o", "_n") if c in keep_first else ("_n", "_o")
        return F.when(F.col(first).isNotNull(), F.col(f"{first}.{c}")).otherwise(F.col(f"{second}.{c}")).alias(c)

    return both.select(*keys, *map(pick, rest)).select(*old.columns)


def insert_new(old: DataFrame, new: DataFrame, keys: list[str], null_safe: bool = False) -> DataFrame:
    """``old`` and those rows of ``new`` whose key it lacks; of new rows of one key, one."""
    fresh = new.dropDuplicates(keys)
    if null_safe:
        o = old.select(*(F.col(k).alias(f"_{k}") for k in keys)).distinct()
        fresh = fresh.join(o, reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys)), "left_anti")
    else:
        fresh = fresh.join(old.select(*keys).distinct(), keys, "left_anti")
    return old.unionByName(fresh.select(*old.columns))


def correct(old: DataFrame, new: DataFrame, keys: list[str], changes: tuple[str, ...]) -> DataFrame:
    """Columns of ``changes`` take the new value where there is one; all others keep the first."""
    rest = [c for c in old.columns if c not in keys]
    n = new.select(*keys, *(F.col(c).alias(f"_{c}") for c in rest))
    return old.join(n, keys, "full").select(*keys, *((F.coalesce(f"_{c}", c) if c in changes else F.coalesce(c, f"_{c}")).alias(c) for c in rest))


def lost_rows(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows of an append-only log that a later snapshot lacks or has changed: empty if the log was only appended to."""
    return before.exceptAll(after.select(*before.columns))


def checked(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """``rows`` with ``reason``: the first rule that isn't met, or null. A rule that is null isn't met."""
    return rows.withColumn("reason", F.coalesce(*(F.when(~F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in rules.items())))


def refuse_columns(rows: DataFrame, banned: tuple[str, ...]) -> DataFrame:
    """``rows``, or an error if they have columns that may only be known after the event."""
    found = sorted(set(banned) & set(rows.columns))
    if found:
        raise ValueError(f"columns known only after the event: {found}")
    return rows


def invalidate(annotations: DataFrame, evaluations: DataFrame, ids: DataFrame, reason: str) -> tuple[DataFrame, DataFrame]:
    """Annotate the predictions of ``ids`` and take their evaluations out."""
    new = ids.select("pred_id", F.lit(reason).alias("reason"))
    return annotations.unionByName(new), evaluations.join(ids.select("pred_id").distinct(), "pred_id", "left_anti")


def switch_champion(versions: DataFrame, promoted: str, reason: str) -> DataFrame:
    """The champion is archived, ``promoted`` takes its place, and its reason grows."""
    mine = F.col("version") == promoted
    return versions.withColumn("status", F.when(mine, "champion").when(F.col("status") == "champion", "archived").otherwise(F.col("status"))).withColumn("reason", F.when(mine, F.concat_ws("; ", "reason", F.lit(reason))).otherwise(F.col("reason")))


def next_version(versions: DataFrame, structural: bool) -> DataFrame:
    """One row: the version after the greatest vX.Y."""
    part = lambda i: F.regexp_extract("version", r"^v(\d+)\.(\d+)$", i).try_cast("int")
    top = versions.agg(F.max(F.struct(part(1).alias("major"), part(2).alias("minor"))).alias("v"))
    major, minor = F.coalesce("v.major", F.lit(0)), F.coalesce("v.minor", F.lit(0))
    return top.select((F.concat(F.lit("v"), (major + 1).cast("string"), F.lit(".0")) if structural else F.concat(F.lit("v"), major.cast("string"), F.lit("."), (minor + 1).cast("string"))).alias("version"))


def content_hash(columns: dict[str, str], digits: int = 8) -> Column:
    """SHA-256 of a JSON object of the columns, sorted by name: doubles rounded and written as text, nulls and what isn't finite as null."""

    def cell(name, kind):
        c = F.col(name)
        if kind in ("double", "float"):
            c = F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(F.format_number(F.round(c, digits), digits))
        return c.alias(name)

    return F.sha2(F.to_json(F.struct(*(cell(n, k) for n, k in sorted(columns.items()))), {"ignoreNullFields": "false"}), 256)


def difference(was: DataFrame, now: DataFrame) -> DataFrame:
    """key, was, now of the keys whose values (key, v) differ."""
    both = was.select("key", F.col("v").alias("was")).join(now.select("key", F.col("v").alias("now")), "key", "full")
    return both.where(~F.col("was").eqNullSafe(F.col("now")))
