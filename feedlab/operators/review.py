"""Ordering, sampling and review of records."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import stored
from .fold import fold_events


def hash_sample(df: DataFrame, columns: list[str], domain: str, seed: str, n: int) -> DataFrame:
    """The n rows of smallest SHA-256 over domain, seed and row: repeatable, whatever the order of the input."""
    rank = F.sha2(F.concat_ws("|", F.lit(domain), F.lit(seed), *[F.col(c).cast("string") for c in columns]), 256)
    return df.withColumn("_rank", rank).orderBy("_rank", *columns).limit(n).drop("_rank")


def replay_rank(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Place of each row in the replay order of its key; nulls come last."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.col(c).asc_nulls_last() for c in order])))


def top_objects(df: DataFrame, order: list[Column], k: int) -> DataFrame:
    """The first k rows."""
    return df.orderBy(*order).limit(k)


def distinct_in_order(df: DataFrame, value: str, order: list[str], k: int) -> DataFrame:
    """The first k distinct values by their first place."""
    return df.groupBy(value).agg(F.min(F.struct(*order)).alias("first")).orderBy("first", value).limit(k)


def review_queue(df: DataFrame, confidence: str, ident: str, top: int | None = None) -> DataFrame:
    """Rank by (confidence, id), ascending. Ranks follow a range partitioning; no task sorts all rows.

    The ranges are written down once, so that ranks within them and their sizes speak of the same ranges. Each range's
    offset is the sum of the sizes before it; the sizes are one row a range.
    """
    ranged = stored(df.repartitionByRange(confidence, ident).withColumn("_part", F.spark_partition_id()), "review-ranges")
    local = ranged.withColumn("_nth", F.row_number().over(Window.partitionBy("_part").orderBy(confidence, ident)))
    sizes = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    out = local.join(F.broadcast(offsets), "_part").withColumn("rank", F.col("_nth") + F.col("_before")).drop("_part", "_nth", "_before")
    return out if top is None else out.where(F.col("rank") <= top)


def precision(df: DataFrame, correct: Column, by: str) -> DataFrame:
    """Per group: reviewed, correct, precision, and the descriptive gate of exactly 50 reviewed with 45 or more correct."""
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("reviewed"), F.count_if(correct).alias("correct"), F.round(F.avg(correct.cast("double")), 6).alias("precision")).withColumn("gate", (F.col("reviewed") == 50) & (F.col("correct") >= 45))


def modal_tag(df: DataFrame, tags: Column) -> DataFrame:
    """The most frequent tag and how often it occurs; the smallest of equally frequent ones."""
    counts = df.select(F.explode(tags).alias("tag")).where("tag <> ''").groupBy("tag").agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.col("n").desc(), "tag").limit(1)


class Joined:
    """SHA-256 of a head and ids joined by commas, fed one by one; null ids are left out."""

    def __init__(self, head: str = ""):
        self.sha, self.comma = hashlib.sha256(head.encode()), b""

    def add(self, ident: str | None) -> None:
        if ident is not None:
            self.sha.update(self.comma + ident.encode())
            self.comma = b","


def stream_digest(df: DataFrame, keys: list[str], order: list[str], ident: str, domain: str = "stream") -> DataFrame:
    """Per key: rows and the SHA-256 over domain, count and ids in order.

    A row with the key's count is sorted before its rows, which then pass through the hash one at a time; no key's rows
    are gathered.
    """
    by = [F.col(c).alias(f"_o{i}") for i, c in enumerate([*order, ident])]
    rows = df.select(*keys, *by, F.col(ident).cast("string").alias("_id"))
    heads = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))

    def reduce(state: dict, row: dict) -> tuple[dict, None]:
        if row["_n"] is not None:
            return {"n": row["_n"], "hash": Joined(f"{domain}|{row['_n']}|")}, None
        state["hash"].add(row["_id"])
        return state, None

    both = heads.unionByName(rows, allowMissingColumns=True)
    return fold_events(both, keys, [F.col("_n").desc_nulls_last(), *[f"_o{i}" for i in range(len(by))]], reduce, dict, "n long, digest string", lambda state: {"n": state["n"], "digest": state["hash"].sha.hexdigest()})


def replay_summary(df: DataFrame, kind: str, order: list[str], amount: str) -> DataFrame:
    """Per kind: rows, summed amount and the last amount in replay order."""
    return df.groupBy(kind).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(amount), 4).alias("total"), F.max_by(amount, F.struct(*order)).alias("terminal"))


def recall(df: DataFrame, truth: Column, found: Column, by: str) -> DataFrame:
    """Per group: true rows, those found, recall (null without true rows), found rows that aren't true."""
    hit = F.count_if(truth & found)
    return df.groupBy(by).agg(F.count_if(truth).alias("true_rows"), hit.alias("hits"), F.round(F.try_divide(hit, F.count_if(truth)), 6).alias("recall"), F.count_if(~truth & found).alias("false_hits"))
