"""Removal of repeated passages: overlapping windows of three consecutive lines, compared over all documents.

Every window of three consecutive lines that hold a word is hashed. Of the occurrences of a window anywhere, the first
in the order (key, text hash, position) stays; the lines that later occurrences cover are merged and removed. Each
removed line has an equal, earlier line that stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACES, let


def dedup_lines(df: DataFrame, key: str = "doc_id", text: str = "text", window: int = 3) -> DataFrame:
    """``df`` with repeated passages taken out of ``text``, and ``n_lines`` and ``n_removed``; one row in, one row out.

    Lines are compared without white space at their ends; blank lines are in no window and stay. Texts of fewer lines
    than ``window``, null and empty texts stay as they are. Rows with equal key and text are one document: they keep or
    lose the same lines. A null key comes first. Columns of ``df`` named like the new ones are replaced.
    """
    df = df.drop("n_lines", "n_removed")
    lines = F.split(F.coalesce(F.col(text), F.lit("")), "\n")
    full = F.filter(F.transform(lines, lambda x, i: F.struct(F.btrim(x, F.lit(SPACES)).alias("s"), i.alias("i"))), lambda x: x["s"] != "")

    def windows(x):
        at = lambda i, k: F.element_at(x, i + k)["s"]
        each = F.transform(F.sequence(F.lit(1), F.size(x) - (window - 1)), lambda i: F.struct(F.xxhash64(*[at(i, k) for k in range(window)]).alias("h"), sum((F.char_length(at(i, k)) for k in range(window)), F.lit(0)).alias("n"), i.alias("i")))
        return F.when(F.size(x) >= window, each)

    text_hash = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    found = df.select(F.col(key).alias("k"), text_hash.alias("t"), F.explode(let(full, windows)).alias("w")).select("k", "t", "w.*")
    first = found.groupBy("h", "n").agg(F.min(F.struct("k", "t", "i")).alias("first"), F.count(F.lit(1)).alias("times")).where("times > 1").drop("times")
    later = found.join(first, ["h", "n"]).where(F.struct("k", "t", "i") > F.col("first"))
    covered = later.groupBy(F.col("k").alias("_k"), F.col("t").alias("_t")).agg(F.collect_set("i").alias("_starts"))
    out = df.withColumn("_th", text_hash)
    out = out.join(covered, out[key].eqNullSafe(covered["_k"]) & (out["_th"] == covered["_t"]), "left").drop("_th", "_k", "_t")

    def gone(x):
        return F.transform(F.array_distinct(F.flatten(F.transform("_starts", lambda i: F.array(*[i + k for k in range(window)])))), lambda j: F.element_at(x, j)["i"])

    out = out.withColumns({"n_lines": F.when(F.col(text).isNull(), F.lit(0)).otherwise(F.size(lines)).cast("long"), "_gone": F.when(F.col("_starts").isNotNull(), let(full, gone))})
    rest = F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("_gone")), lambda i: F.get(F.col("_all"), i))
    out = out.withColumn("_all", F.when(F.col("_gone").isNotNull(), lines))
    out = out.withColumns({text: F.when(F.col("_gone").isNull(), F.col(text)).otherwise(F.array_join(rest, "\n")), "n_removed": F.coalesce(F.size("_gone"), F.lit(0)).cast("long")})
    return out.withColumn("n_removed", F.greatest("n_removed", F.lit(0).cast("long"))).drop("_starts", "_gone", "_all")
