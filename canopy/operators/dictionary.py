"""Dictionaries: linear tables, distributions by context, and looking values up in them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import trees

PREFIX = 3  # characters by which a large table is ranked in blocks


def dense_index(table: DataFrame, value: str, name: str = "idx") -> DataFrame:
    """Adds the rank of value from 0, nulls first, without sorting all rows in one task.

    Rows are ranked inside blocks of equal first characters, whose order is that of
    the values; only the number of rows of each block meets in one task."""
    block = F.substring(value, 1, PREFIX)
    t = table.withColumn("_block", block)
    before = Window.orderBy(F.col("_block").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    sizes = t.groupBy("_block").agg(F.count("*").alias("_n")).select(F.col("_block").alias("_b"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_at"))
    own = F.row_number().over(Window.partitionBy("_block").orderBy(F.col(value).asc_nulls_first())) - 1
    ranked = t.withColumn("_own", own).join(sizes, F.col("_block").eqNullSafe(F.col("_b")))
    return ranked.withColumn(name, (F.col("_at") + F.col("_own")).cast("long")).drop("_block", "_b", "_at", "_own")


def linear_table(frequency: DataFrame, threshold: int, value: str = "value") -> DataFrame:
    """(value, files, idx): values of more than threshold files, with dense indices in order of value."""
    return dense_index(frequency.where(F.col("files") > threshold).select(value, "files"), value)


def by_usage(counts: DataFrame, value: str = "value") -> DataFrame:
    """Adds idx: the rank by use, most used first, then by value.

    Values of one use count form a block, and blocks are few."""
    before = Window.orderBy(F.col("_c").desc()).rowsBetween(Window.unboundedPreceding, -1)
    sizes = counts.groupBy(F.col("n").alias("_c")).agg(F.count("*").alias("_n")).select("_c", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_at"))
    block = F.substring(value, 1, PREFIX)
    t = counts.withColumn("_block", block)
    in_use = Window.partitionBy("_u").orderBy(F.col("_p").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    parts = t.groupBy(F.col("n").alias("_u"), F.col("_block").alias("_p")).agg(F.count("*").alias("_m"))
    parts = parts.select("_u", "_p", F.coalesce(F.sum("_m").over(in_use), F.lit(0)).alias("_in"))
    own = F.row_number().over(Window.partitionBy("n", "_block").orderBy(F.col(value).asc_nulls_first())) - 1
    ranked = t.withColumn("_own", own).join(parts, (F.col("n") == F.col("_u")) & F.col("_block").eqNullSafe(F.col("_p"))).join(sizes, F.col("n") == F.col("_c"))
    return ranked.withColumn("idx", (F.col("_at") + F.col("_in") + F.col("_own")).cast("long")).select(*counts.columns, "idx")


def with_prelude(shared: DataFrame, prelude: DataFrame, key: str = "value") -> DataFrame:
    """shared (value, idx) and prelude in one table with origin; a value in both is refused."""
    twice = shared.join(prelude, key, "left_semi").limit(1).collect()
    if twice:
        raise ValueError(f"{twice[0][key]!r} is in the shared table already")
    return shared.select(key, "idx", F.lit("shared").alias("origin")).union(prelude.select(key, "idx", F.lit("prelude").alias("origin")))


def hits(tokens: DataFrame, table: DataFrame, key: str = "value") -> DataFrame:
    """tokens with the table's idx, null where the value is missing; nulls meet nulls."""
    t = table.select(F.col(key).alias("_k"), "idx")
    return tokens.join(t, F.col(key).eqNullSafe(F.col("_k")), "left").drop("_k")


def misses(tokens: DataFrame, table: DataFrame, key: str = "value") -> DataFrame:
    t = table.select(F.col(key).alias("_k"))
    return tokens.join(t, F.col(key).eqNullSafe(F.col("_k")), "left_anti")


def distributions(counts: DataFrame, context: list[str], value: str) -> DataFrame:
    """Adds symbol_index, lo, hi and total: the cumulative counts of each context in order of value, nulls first."""
    w = Window.partitionBy(*context).orderBy(F.col(value).asc_nulls_first())
    upto = w.rowsBetween(Window.unboundedPreceding, -1)
    lo = F.coalesce(F.sum("n").over(upto), F.lit(0))
    return counts.select(
        *context, value, "n",
        (F.row_number().over(w) - 1).cast("long").alias("symbol_index"),
        lo.alias("lo"), (lo + F.col("n")).alias("hi"), F.sum("n").over(Window.partitionBy(*context)).alias("total"),
    )


def probability() -> Column:
    return F.col("n") / F.col("total")


def add_if_absent(counts: DataFrame, more: DataFrame, keys: list[str]) -> DataFrame:
    """counts, and with n = 1 those rows of more that it lacks."""
    a, b = counts.select(*keys, "n"), more.select(*keys).distinct()
    same = reduce(lambda x, y: x & y, (b[k].eqNullSafe(a[k]) for k in keys))
    return a.unionByName(b.join(a, same, "left_anti").withColumn("n", F.lit(1).cast("long")))


def fallback_contexts(counts: DataFrame, baseline: DataFrame, full: list[str], tail: list[str], value: str) -> DataFrame:
    """Extends every known context by the baseline's values of its tail, then adds the tails themselves.

    counts: full context (its last columns are the tail), value, n; baseline: tail, value.
    Tails stand in the result with nulls for the outer columns and depth 1."""
    outer = [c for c in full if c not in tail]
    known = counts.select(*full).distinct()
    possible = known.join(baseline.select(*tail, value).distinct(), tail).select(*full, value)
    long = add_if_absent(counts, possible, [*full, value]).withColumn("depth", F.lit(len(full)))
    short = baseline.select(*(F.lit(None).cast("string").alias(c) for c in outer), *tail, value).distinct()
    return long.unionByName(short.select(*full, value, F.lit(1).cast("long").alias("n"), F.lit(len(tail)).alias("depth")))


def with_total(counts: DataFrame, context: list[str]) -> DataFrame:
    """counts with total, the sum of n of each context: what a lookup needs of distributions, without putting a context in order."""
    sums = counts.groupBy(*(F.col(c).alias(f"_{c}") for c in context)).agg(F.sum("n").alias("total"))
    same = reduce(lambda x, y: x & y, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in context))
    return counts.join(sums, same).select(*counts.columns, "total")


def fallback_lookup(tokens: DataFrame, deep: DataFrame, shallow: DataFrame, full: list[str], tail: list[str], value: str) -> DataFrame:
    """tokens with used_depth, n and total from the first known context of [full, tail].

    The known context decides, also where it lacks the value: then n is null.
    Contexts are few, so they are sought for each distinct (full, value) and not
    for each token; tokens are joined once, by all of these columns."""
    d = deep.select(*(F.col(c).alias(f"_d_{c}") for c in full)).distinct().withColumn("_deep", F.lit(True))
    s = shallow.select(*(F.col(c).alias(f"_s_{c}") for c in tail)).distinct().withColumn("_shallow", F.lit(True))

    def same(prefix: str, cols: list[str]) -> Column:
        return reduce(lambda x, y: x & y, (F.col(c).eqNullSafe(F.col(f"{prefix}{c}")) for c in cols))

    asked = tokens.groupBy(*full, value).agg(F.count("*").alias("n")).where("n > 0").drop("n")  # n stays in the plan, so the exchange of equal counts is used again
    t = asked.join(d, same("_d_", full), "left").join(s, same("_s_", tail), "left")
    t = t.withColumn("used_depth", F.when(F.col("_deep"), len(full)).when(F.col("_shallow"), len(tail)).otherwise(-1))
    t = t.drop(*(f"_d_{c}" for c in full), *(f"_s_{c}" for c in tail), "_deep", "_shallow")
    dv = deep.select(*(F.col(c).alias(f"_d_{c}") for c in full), F.col(value).alias("_dv"), F.col("n").alias("_dn"), F.col("total").alias("_dt"))
    sv = shallow.select(*(F.col(c).alias(f"_s_{c}") for c in tail), F.col(value).alias("_sv"), F.col("n").alias("_sn"), F.col("total").alias("_st"))
    t = t.join(dv, same("_d_", full) & F.col(value).eqNullSafe(F.col("_dv")) & (F.col("used_depth") == len(full)), "left")
    t = t.join(sv, same("_s_", tail) & F.col(value).eqNullSafe(F.col("_sv")) & (F.col("used_depth") == len(tail)), "left")
    found = t.select(*(F.col(c).alias(f"_f_{c}") for c in [*full, value]), "used_depth", F.coalesce("_dn", "_sn").alias("n"), F.coalesce("_dt", "_st").alias("total"))
    return tokens.join(found, same("_f_", [*full, value]), "left").select(*tokens.columns, "used_depth", "n", "total")


def value_at(dists: DataFrame, wanted: DataFrame, context: list[str], value: str) -> DataFrame:
    """The value at (context, symbol_index): the inverse of distributions."""
    d = dists.select(*(F.col(c).alias(f"_{c}") for c in context), F.col("symbol_index").alias("_i"), F.col(value).alias("decoded"))
    same = reduce(lambda x, y: x & y, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in context))
    return wanted.join(d, same & (F.col("symbol_index") == F.col("_i")), "left").drop("_i", *(f"_{c}" for c in context))


def nearest_scoped(nodes: DataFrame, scoped: DataFrame) -> DataFrame:
    """(file_id, node_id, dictionary): that of the nearest ancestor-or-self in scoped (file_id, node_id, dictionary), else ''.

    Of several dictionaries of one node the greatest name counts."""
    one = scoped.groupBy("file_id", "node_id").agg(F.max("dictionary").alias("_dictionary"), F.lit(True).alias("_scoped"))
    n = nodes.select("file_id", "node_id", "pre", "post").join(one, ["file_id", "node_id"], "left")
    return trees.nearest(n, F.col("_scoped"), F.col("_dictionary")).select("file_id", "node_id", F.coalesce("nearest", F.lit("")).alias("dictionary"))


def value_of(references: DataFrame, shared: DataFrame, preludes: DataFrame, key: str = "value") -> DataFrame:
    """references (file_id, origin, idx, and more) with the value that each names: in the shared table or in its file's prelude.

    shared: value, idx; preludes: file_id, value, idx. A reference beyond its table has a null value."""
    s = shared.select(F.col("idx").alias("_si"), F.col(key).alias("_sv"))
    p = preludes.select(F.col("file_id").alias("_f"), F.col("idx").alias("_pi"), F.col(key).alias("_pv"))
    found = references.join(s, (F.col("origin") == "shared") & (F.col("idx") == F.col("_si")), "left")
    found = found.join(p, (F.col("origin") == "prelude") & (F.col("file_id") == F.col("_f")) & (F.col("idx") == F.col("_pi")), "left")
    return found.select(*references.columns, F.when(F.col("origin") == "shared", F.col("_sv")).otherwise(F.col("_pv")).alias(key))
