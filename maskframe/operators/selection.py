"""Top rows of groups, seeded samples and splits, set operations on rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_of(df: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first n rows of each group in a total order."""
    return df.withColumn("__rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("__rank") <= n).drop("__rank")


def diversified(df: DataFrame, kind: str, case: str, order: list[Column], n: int) -> DataFrame:
    """n rows: first the best one of each kind, then further cases. The rows of a kind are cut to the first before they are
    shuffled, so no task holds a kind; the first rows themselves leave with their cases."""
    one = first_of(df, [kind], order).withColumn("tier", F.lit(1))
    taken = one.select(F.col(case).alias("__taken")).distinct()
    more = first_of(df.join(taken, df[case].eqNullSafe(taken["__taken"]), "left_anti"), [case], order).withColumn("tier", F.lit(2))
    return one.unionByName(more).orderBy("tier", *order).limit(n)


def seeded(key: Column, seed: int = 42) -> Column:
    """A repeatable pseudo-random order of rows."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    return df.orderBy(seeded(F.col(key), seed), key).limit(n)


def _joined(df: DataFrame, group: str, named: DataFrame) -> DataFrame:
    """df with the columns of named (__group, ...); a null group is a group."""
    return df.join(named, df[group].eqNullSafe(named["__group"])).drop("__group")


def _places(df: DataFrame, group: str, seed: int) -> DataFrame:
    """(__group, place, total): groups numbered from 1 in hash order. They are ranked inside 256 hash ranges whose counts are
    summed up, so no task ranks all of them."""
    g = df.select(F.col(group).alias("__group")).distinct().withColumn("h", F.coalesce(seeded(F.col("__group"), seed), F.lit("00"))).withColumn("b", F.substring("h", 1, 2))
    counts = g.groupBy("b").agg(F.count(F.lit(1)).alias("c"))
    all_ = Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)  # 256 rows
    starts = counts.select("b", F.coalesce(F.sum("c").over(all_), F.lit(0)).alias("before"), F.sum("c").over(Window.partitionBy()).alias("total"))
    own = F.row_number().over(Window.partitionBy("b").orderBy("h", "__group"))
    return g.withColumn("own", own).join(starts, "b").select("__group", (F.col("before") + F.col("own")).alias("place"), "total")


def with_split(df: DataFrame, group: str, test_share: float = 0.2, seed: int = 42) -> DataFrame:
    """Adds split: whole groups go to test, ceil(share * groups) of them."""
    split = F.when(F.col("place") <= F.ceil(F.col("total") * test_share), "test").otherwise("train")
    return _joined(df, group, _places(df, group, seed).select("__group", split.alias("split")))


def group_sizes(df: DataFrame, key: str) -> DataFrame:
    return _joined(df, key, df.groupBy(F.col(key).alias("__group")).agg(F.count(F.lit(1)).alias("group_size")))


def top(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first row of each group, and of those the first n."""
    return first_of(df, keys, order).orderBy(*order).limit(n)


def priority_first(df: DataFrame, key: str, values: list[int], order: list[Column], n: int) -> DataFrame:
    """n rows: those with a key of values, in their order, come before all others."""
    at = F.array_position(F.array(*map(F.lit, values)), F.col(key))
    return df.orderBy(F.when(at > 0, at).otherwise(len(values) + 1), *order).limit(n)


def with_splits(df: DataFrame, group: str, shares: dict[str, float], seed: int = 42) -> DataFrame:
    """Adds split: whole groups in the hash order of with_split(), ranked once and cut at the shares' sums."""
    names, total, upto = list(shares), sum(shares.values()), 0.0
    if len(names) == 1:
        return df.withColumn("split", F.lit(names[0]))
    split = F.when(F.lit(False), "")
    for name in names[:-1]:
        upto += shares[name] / total
        split = split.when(F.col("place") <= F.ceil(F.col("total") * upto), name)
    return _joined(df, group, _places(df, group, seed).select("__group", split.otherwise(names[-1]).alias("split")))


def without(df: DataFrame, chosen: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that are not chosen yet."""
    return df.join(chosen.select(*keys).distinct(), keys, "left_anti")


#: Fixed value: wisdom teeth.
WISDOM = ("18", "28", "38", "48")


def showcases(rows: DataFrame, n: int, high: float = 0.85, low: float = 0.60) -> DataFrame:
    """Selections by category, n rows each, one of a case: perfect (matched, sure), complex (label with two or more zones, most
    complex first), second_opinion (missed and sure), honest_mistake (wrong and unsure, in hash order), wisdom.
    rows: (case_id, id, tooth_id, matched, confidence, label)."""
    from ..functions.scalars import complexity

    sure, key = F.col("confidence"), [F.col("case_id"), F.col("id")]
    kinds = {
        "perfect": (F.col("matched") & (sure > high), [F.desc("confidence"), *key]),
        "complex": (F.col("label").rlike("MO|DO|MOD"), [F.desc(complexity(F.col("label"))), F.desc("confidence"), *key]),
        "second_opinion": (~F.col("matched") & (sure > high), [F.desc("confidence"), *key]),
        "honest_mistake": (~F.col("matched") & (sure < low), [seeded(F.col("id")), *key]),
        "wisdom": (F.col("tooth_id").isin(*WISDOM), [F.desc("confidence"), *key]),
    }
    out = None
    for name, (which, order) in kinds.items():
        one = top(rows.filter(which), ["case_id"], order, n).withColumn("category", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out
