"""Tables that are changed by batches, over plain Parquet: each change writes a new version, then moves the pointer.

Three policies decide on a row whose key the table has: ``ignore`` keeps the table's, ``replace`` takes the batch's last,
``max_score`` keeps the one of the earliest
``order`` (the table's, where batches come in order) but for the higher score and the later time. Rows with a null in their key never meet
another row where ``null_safe`` is off, as in tables whose unique index ignores nulls.
"""

from __future__ import annotations

import re
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .rank import first_of_each

POLICIES = ("ignore", "replace", "max_score")


def upsert(table: DataFrame, batch: DataFrame, keys: list[str], policy: str, order: str, score: str = "score", seen: str = "last_seen") -> DataFrame:
    """The table after the batch. order: a column of both that grows with time."""
    if policy not in POLICIES:
        raise ValueError(f"policy is one of {POLICIES}")
    whole = reduce(and_, (F.col(k).isNotNull() for k in keys))
    loose = batch.filter(~whole)
    if policy == "ignore":
        fresh = first_of_each(batch.filter(whole), keys, [F.asc(order)]).join(table.select(*keys).distinct(), keys, "left_anti")
        return table.unionByName(fresh.select(table.columns)).unionByName(loose.select(table.columns))
    if policy == "replace":
        both = table.withColumn("_new", F.lit(0)).unionByName(batch.select(table.columns).withColumn("_new", F.lit(1)))
        kept = first_of_each(both.filter(whole), keys, [F.desc("_new"), F.desc(order)])
        return kept.unionByName(both.filter(~whole)).drop("_new").select(table.columns)
    news = batch.filter(whole).groupBy(*keys).agg(F.max(score).alias("_score"), F.max(seen).alias("_seen"), F.min_by(F.struct(*table.columns), order).alias("_row"))
    old = table.withColumn("_old", F.lit(True))
    joined = old.join(news.select(*(F.col(k).alias(f"_{k}") for k in keys), "_score", "_seen", "_row"), reduce(and_, (F.col(k) == F.col(f"_{k}") for k in keys)), "full")
    stays = F.col("_old").isNotNull() & (F.col("_row").isNull() | F.coalesce(F.col(order) <= F.col(f"_row.{order}"), F.lit(True)))
    value = {c: F.when(stays, F.col(c)).otherwise(F.col(f"_row.{c}")) for c in table.columns}
    value[score] = F.greatest(F.col(score), F.col("_score"))
    value[seen] = F.greatest(F.col(seen), F.col("_seen"))
    return joined.select(*(c.alias(n) for n, c in value.items())).unionByName(loose.select(table.columns))


def settled(batch: DataFrame, keys: list[str], policy: str, order: str = "ord") -> DataFrame:
    """One row of each whole key, as if the batch's rows came one by one by ``order`` (nulls last): the first where the table's row is kept, else the last. Ties go to the least hash of the row.
    Rows with a null in their key all stay."""
    whole = reduce(and_, (F.col(k).isNotNull() for k in keys))
    by = [F.xxhash64(*batch.columns)]
    if order in batch.columns:
        by.insert(0, F.asc_nulls_last(order) if policy == "ignore" else F.desc_nulls_last(order))
    return first_of_each(batch.filter(whole), keys, by).unionByName(batch.filter(~whole))


def set_status(table: DataFrame, done: DataFrame, key: str, status: str = "done") -> DataFrame:
    """Rows whose key is in ``done`` get the status."""
    marks = done.select(F.col(key).alias("_k")).distinct().withColumn("_hit", F.lit(True))
    return table.join(marks, table[key] == F.col("_k"), "left").withColumn("status", F.when(F.col("_hit"), status).otherwise(F.col("status"))).select(table.columns)


class Store:
    """A folder of versions of one table. The newest version that is complete counts; a writer that dies leaves none."""

    def __init__(self, spark: SparkSession, path: str, schema):
        self.spark, self.path, self.schema, self._taken = spark, path.rstrip("/"), schema, 0

    def _fs(self):
        jvm = self.spark._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        return root.getFileSystem(self.spark._jsc.hadoopConfiguration()), root, jvm

    def _versions(self) -> list[tuple[int, str, int, str]]:
        """Number, stream, batch and folder of the complete versions, the newest last. A folder's name says which batch of which stream it holds, if any."""
        fs, root, jvm = self._fs()
        if not fs.exists(root):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(root)]
        found = [(int(m[1]), m[2] or "", int(m[3] or -1), n) for n in names if (m := re.fullmatch(r"v(\d+)(?:-([0-9a-f]+)-(\d+))?", n))]
        self._taken = max((v[0] for v in found), default=0)
        return sorted(v for v in found if fs.exists(jvm.org.apache.hadoop.fs.Path(f"{self.path}/{v[3]}/_SUCCESS")))

    def version(self) -> int:
        return self._versions()[-1][0] if self._versions() else 0

    def read(self) -> DataFrame:
        """Columns that older versions lack are null."""
        have = self._versions()
        if not have:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/{have[-1][3]}")

    def write(self, rows: DataFrame, stream: str = "", batch: int = -1) -> int:
        """A new version. Its number is beyond all that were begun; of two writers that take the same number the later one fails and overwrites nothing."""
        have = self._versions()
        v = self._taken + 1
        if have and not stream:
            stream, batch = have[-1][1:3]
        rows.write.parquet(f"{self.path}/v{v}" + (f"-{stream}-{batch}" if stream else ""))
        fs, _, jvm = self._fs()
        for *_, old in have[:-1]:  # readers of the version before still find it
            fs.delete(jvm.org.apache.hadoop.fs.Path(f"{self.path}/{old}"), True)
        return v

    def merge(self, batch: DataFrame, keys: list[str], policy: str, order: str, **options) -> int:
        """Apply a batch; gives the number of rows added."""
        before = self.read()
        n = before.count()
        self.write(upsert(before, batch, keys, policy, order, **options))
        return self.read().count() - n

    def change_once(self, change, stream: str, number: int) -> bool:
        """Store ``change(table)`` for a stream's batch unless the table has it already; so one that is run again adds nothing, rows of null key included."""
        have = self._versions()
        if have and have[-1][1] == stream and have[-1][2] >= number:
            return False
        self.write(change(self.read()), stream, number)
        return True

    def merge_once(self, batch: DataFrame, stream: str, number: int, keys: list[str], policy: str, order: str, **options) -> bool:
        """Apply a stream's batch once."""
        return self.change_once(lambda table: upsert(table, batch, keys, policy, order, **options), stream, number)

    def reset(self) -> int:
        return self.write(self.spark.createDataFrame([], self.schema))

    def has_columns(self, names) -> bool:
        return set(names) <= set(self.read().columns)
