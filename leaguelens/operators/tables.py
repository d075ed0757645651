"""Table operations beyond single joins: fills, group statistics, updates, traversals, views."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leaguelens.operators.contracts import Contract, conform


def from_records(spark: SparkSession, rows: list[dict], contract: Contract) -> DataFrame:
    """A table of records with the contract's types, leniently cast; missing fields are null, other fields go."""
    plain = {c: t for c, t in contract.types.items() if not t.startswith("array")}
    schema = ", ".join(f"`{c}` {'string' if c in plain else t}" for c, t in contract.types.items())
    text = lambda c, v: v if v is None or c not in plain else str(v)
    return conform(spark.createDataFrame([tuple(text(c, r.get(c)) for c in contract.types) for r in rows], schema), contract)


def fill_back_then_on(df: DataFrame, group: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """Nulls take the next value of their group, and those left the last one before them in the whole order.

    The second fill crosses groups.  It is carried by one row a group (its last value), so
    only that small table is ordered as a whole.
    """
    within = Window.partitionBy(*group).orderBy(*order).rowsBetween(0, Window.unboundedFollowing)
    seen = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    back = df.withColumns({c: F.first(c, ignorenulls=True).over(within) for c in columns})
    ends = back.groupBy(*group).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.struct(*order))).alias(c) for c in columns])
    before = Window.orderBy(*group).rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(*group, *[F.last(c, ignorenulls=True).over(before).alias(f"__{c}") for c in columns])
    out = back.withColumns({c: F.last(c, ignorenulls=True).over(seen) for c in columns})
    on = reduce(lambda a, b: a & b, [F.col(g).eqNullSafe(F.col(f"__g_{g}")) for g in group])
    carried = carried.withColumnsRenamed({g: f"__g_{g}" for g in group})
    return out.join(carried, on, "left").select(*[F.coalesce(c, f"__{c}").alias(c) if c in columns else F.col(c) for c in df.columns])


def not_in(df: DataFrame, key: str, others: DataFrame, other: str) -> DataFrame:
    """Rows whose ``key`` is NOT IN the column ``other`` of ``others``, with SQL's nulls.

    None, if ``others`` has a null; all, if it has no row; null keys only in the latter case.
    Spark broadcasts all of ``others`` for this; here only its two counts are broadcast.
    """
    keys = others.select(F.col(other).alias("__k"))
    counts = keys.agg(F.count(F.lit(1)).alias("__n"), F.count("__k").alias("__known"))
    apart = df.hint("merge").join(keys.where("__k is not null").hint("merge"), F.col(key) == F.col("__k"), "left_anti")
    kept = (F.col("__n") == 0) | ((F.col("__n") == F.col("__known")) & F.col(key).isNotNull())
    return apart.crossJoin(F.broadcast(counts)).where(kept).select(*df.columns)


def per_game(df: DataFrame, stat: str, count: str, group: list[str], name: str = "ppg") -> DataFrame:
    """Adds the group's mean of ``stat``, its non-null ``count`` as gp and the rank of its mean.

    The rank is over groups that share the first two columns of ``group``, ties by the rest.
    """
    means = df.groupBy(*group).agg(F.avg(stat).alias(name), F.count(count).alias("gp"))
    order = Window.partitionBy(*group[:2]).orderBy(F.desc_nulls_last(name), *group[2:])
    ranked = means.withColumn(f"posrk_{name}_year", F.row_number().over(order))
    return df.join(ranked, group, "left")


def correlation_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows (a, b, corr) for every two columns, and 1 for each with itself, from one aggregation; rows where either is null don't count for a pair."""
    pairs = list(combinations(columns, 2))
    found = df.agg(*[F.corr(F.when(F.col(b).isNotNull(), F.col(a)), F.when(F.col(a).isNotNull(), F.col(b))).alias(f"{a} {b}") for a, b in pairs])
    cell = lambda a, b, x: F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), x.alias("corr"))
    cells = [cell(x, y, F.col(f"`{a} {b}`")) for a, b in pairs for x, y in ((a, b), (b, a))] + [cell(a, a, F.lit(1.0)) for a in columns]
    return found.select(F.inline(F.array(*cells)))


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row per column: count, mean, sample deviation, min, quartiles (interpolated) and max."""
    aggs = []
    for c in columns:
        x = F.col(c).cast("double")
        parts = [F.count(x).alias("count"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.min(x).alias("min")]
        parts += [F.percentile(x, q).alias(n) for q, n in ((0.25, "p25"), (0.5, "p50"), (0.75, "p75"))] + [F.max(x).alias("max")]
        aggs.append(F.struct(F.lit(c).alias("column"), *parts).alias(f"s_{c}"))
    return df.agg(*aggs).select(F.inline(F.array(*[F.col(f"`s_{c}`") for c in columns])))


def update_from(target: DataFrame, changes: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """``target`` with ``columns`` taken from the row of ``changes`` with the same keys, where there is one; a null there is taken too."""
    new = changes.select(*[F.col(k).alias(f"__{k}") for k in keys], F.struct(*columns).alias("__new")).dropDuplicates([f"__{k}" for k in keys])
    met = target.join(new, reduce(lambda a, b: a & b, [F.col(k) == F.col(f"__{k}") for k in keys]), "left")
    return met.select(*[F.when(F.col("__new").isNotNull(), F.col("__new")[c]).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in target.columns])


def traverse(start: DataFrame, *maps: tuple[DataFrame, str, str]) -> DataFrame:
    """Follow maps one after the other: each (table, from, to) joins on the column reached before; rows that fall out of a map keep null from there on."""
    out = start
    for table, source, target in maps:
        link = table.select(F.col(source).alias("__from"), F.col(target).alias(f"__to_{target}")).dropDuplicates(["__from"])
        out = out.join(link, F.col(source) == F.col("__from"), "left").drop("__from").withColumnRenamed(f"__to_{target}", target)
    return out


def suffix_join(left: DataFrame, right: DataFrame, keys: list[str], suffix: str = "_r", how: str = "left") -> DataFrame:
    """Join on ``keys``; other columns of ``right`` that ``left`` has too get the suffix."""
    both = [c for c in right.columns if c in left.columns and c not in keys]
    return left.join(right.withColumnsRenamed({c: c + suffix for c in both}), keys, how)


def by_key(df: DataFrame, contract: Contract) -> DataFrame:
    """Rows in the order of the contract's key columns that the table has."""
    present = [c for c in contract.key if c in df.columns]
    return df.orderBy(*present) if present else df


def current_view(facts: DataFrame, dimension: DataFrame, keys: list[str], name: str | None = None) -> DataFrame:
    """Current rows of a slowly changing table with their dimension's columns; ``name`` also makes it a view."""
    out = suffix_join(facts.where("is_current"), dimension, keys, "_dim", "inner")
    if name:
        out.createOrReplaceTempView(name)
    return out


def create_table_sql(table: str, contract: Contract, comments: dict[str, str] | None = None) -> str:
    """A CREATE TABLE statement with NOT NULL, comments and the key as a table property, as Parquet keeps no constraint."""
    quote = lambda s: s.replace("\\", "\\\\").replace("'", "\\'")
    rows = []
    for c, t in contract.types.items():
        note = f" COMMENT '{quote((comments or {})[c])}'" if c in (comments or {}) else ""
        rows.append(f"`{c}` {t}{' NOT NULL' if c in contract.required or c in contract.key else ''}{note}")
    key = f" TBLPROPERTIES ('primary_key' = '{','.join(contract.key)}')" if contract.key else ""
    return f"CREATE TABLE IF NOT EXISTS {table} ({', '.join(rows)}) USING parquet{key}"


def part_of_key(key: Column, n: int, by: str = ".") -> Column:
    """The n-th part of a key (from 1; below zero from the end); null if there is none."""
    return F.try_element_at(F.split(key, r"\Q" + by + r"\E"), F.lit(n))
