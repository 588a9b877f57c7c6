"""Ranking, caps and quotas as windows. Order is always by named columns; ``ord`` is the order of the input."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def numbered(df: DataFrame, by: list, order: list, name: str = "rn") -> DataFrame:
    return df.withColumn(name, F.row_number().over(W.partitionBy(*by).orderBy(*order)))


def first_of_each(df: DataFrame, by: list, order: list) -> DataFrame:
    """The first row of each group. Nulls in ``by`` are a group of their own."""
    return numbered(df, by, order, "_n").filter("_n = 1").drop("_n")


def cap(df: DataFrame, group: str, order: list, n: int, total: int | None = None) -> DataFrame:
    """The first n rows of each group, then the first ``total`` rows."""
    kept = numbered(df, [group], order, "_n").filter(F.col("_n") <= n).drop("_n")
    return kept.orderBy(*order).limit(total) if total is not None else kept


def top(df: DataFrame, order: list, n: int) -> DataFrame:
    return df.orderBy(*order).limit(n)


def prioritized(df: DataFrame, score: str, order: str = "ord") -> DataFrame:
    """By descending score, equals in the order of the input."""
    return df.orderBy(F.desc(score), F.asc(order))


def diversified(df: DataFrame, group: str, score: str, order: str, n: int, caps: dict[str, int], first: int = 6) -> DataFrame:
    """The best row of each of the best ``first`` groups, then the best rows, as far as the groups' caps allow; n rows in all.

    Rows of negative score never count. Gives ``phase`` and ``place``. Each group is cut to n rows before the groups are
    put in one order, so the last step sees at most n rows a group. The bound by the number n, apart from the caps, lets Spark cut
    groups within each partition before the shuffle, too (up to spark.sql.optimizer.windowGroupLimitThreshold), so a large group sends n rows a task.
    """
    if n <= 0:
        return df.limit(0).withColumn("phase", F.lit(0)).withColumn("place", F.lit(0))
    best = [F.desc(score), F.asc(order)]
    limit = F.least(F.coalesce(F.create_map(*(F.lit(x) for kv in caps.items() for x in kv))[F.col(group)], F.lit(n)), F.lit(n)) if caps else F.lit(n)
    rows = numbered(df.filter(F.col(score) >= 0), [group], best, "_rn").filter(F.col("_rn") <= n).filter((F.col("_rn") <= limit) | (F.col("_rn") == 1))
    leaders = rows.filter("_rn = 1").orderBy(*best).limit(min(n, first)).select(F.col(group).alias("_leader"))
    rows = rows.join(F.broadcast(leaders), rows[group].eqNullSafe(F.col("_leader")), "left")  # at most ``first`` rows
    rows = rows.withColumn("phase", F.when((F.col("_rn") == 1) & F.col("_leader").isNotNull(), 1).otherwise(2)).filter((F.col("_rn") <= limit) | (F.col("phase") == 1))
    chosen = rows.orderBy("phase", *best).limit(n)
    return chosen.withColumn("place", F.row_number().over(W.orderBy("phase", *best))).drop("_rn", "_leader")


def round_robin(df: DataFrame, group: str, score: str, order: str, n: int, least: int = 3) -> DataFrame:
    """n rows dealt out to the groups in turns, larger groups first, until each has its quota of max(least, n / groups); what is
    left is filled up group by group. Gives ``place``. Each group is cut to n rows first."""
    if n <= 0:
        return df.limit(0).withColumn("place", F.lit(0))
    rows = df.filter(F.col(score) >= 0)
    sizes = rows.groupBy(group).agg(F.count("*").alias("_size"), F.min(order).alias("_first"))
    sizes = sizes.withColumn("_group", F.row_number().over(W.orderBy(F.desc("_size"), "_first"))).withColumn("_quota", F.greatest(F.lit(least), F.ceil(F.lit(n) / F.count("*").over(W.partitionBy()))))
    cut = numbered(rows, [group], [F.desc(score), F.asc(order)], "_rn").filter(F.col("_rn") <= n)
    dealt = cut.join(sizes.withColumnRenamed(group, "_g"), cut[group].eqNullSafe(F.col("_g")))
    turn = F.when(F.col("_rn") <= F.col("_quota"), F.struct(F.lit(0).alias("a"), F.col("_rn").alias("b"), F.col("_group").alias("c"))).otherwise(F.struct(F.lit(1).alias("a"), F.col("_group").alias("b"), F.col("_rn").alias("c")))
    chosen = dealt.withColumn("_turn", turn).orderBy("_turn").limit(n)
    return chosen.withColumn("place", F.row_number().over(W.orderBy("_turn"))).drop("_turn", "_g", "_size", "_first", "_group", "_quota", "_rn")


def budget(most: int, have: int) -> int:
    """How many details may still be fetched after the first round."""
    return max(most // 2, max(0, most - have))


QUALITY_ORDER = {"high": 0, "medium": 1, "low": 2}
ACTIVE_ORDER = {"active": 0, "listed": 1, "unknown": 2, "closed": 3}


def default_order(quality: str, status: str, score: str, tie: str) -> list[Column]:
    """Quality, status, score, for lists that people read."""
    of = lambda c, d: F.coalesce(F.create_map(*(F.lit(x) for kv in d.items() for x in kv))[F.col(c)], F.lit(9))
    return [of(quality, QUALITY_ORDER), of(status, ACTIVE_ORDER), F.desc(score), F.asc(tie)]


def page_of(df: DataFrame, order: list, page: int, size: int) -> DataFrame:
    return df.orderBy(*order).offset((page - 1) * size).limit(size)
