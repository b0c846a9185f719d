"""Filter interaction audit: what each filter removes, alone and after any others, told by relations of failing ids.

Each filter has a table of the ids that fail it. The survivors of a prefix of filters are what a left-anti join with the
tables of its filters leaves; what the next filter removes are the survivors that a left-semi join with its table finds.
A prefix is a set of filters here (its order doesn't matter), so that five filters have 32 of them, and both joins run
over all prefixes at once: rows carry their prefix, and a partner counts only if its filter is in it. Rows that fail
nothing survive every prefix and are only counted.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, stored, words

#: Columns of the audit's counts.
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def text_filters(text: Column) -> dict[str, Column]:
    """The filters that look at one text (true: it fails): short, repetitive, upper case, symbols."""
    t = F.coalesce(text, F.lit(""))
    return {
        "A": F.col("_words.n") < 200,
        "B": 100 * F.col("_words.d") < 50 * F.col("_words.n"),
        "C": 100 * F.regexp_count(t, F.lit("[A-Z]")) > 2 * F.char_length(t),
        "D": t.rlike(r"[#$%&*|]"),
    }


def judged(docs: DataFrame, key: str = "doc_id", part: str = "source", text: str = "text") -> DataFrame:
    """One narrow row a document: doc, mark (they tell rows apart), has_id, part, digest of the text, letters of the failed text filters.

    A null text is an empty one, a null part is ''. Rows with a null key are told apart by their text alone.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    counted = docs.withColumn("_words", let(words(F.col(text)), lambda w: F.struct(F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("d"))))
    failed = F.array_compact(F.array(*[F.when(fails, F.lit(name)) for name, fails in text_filters(F.col(text)).items()]))
    mark = F.xxhash64(F.col(key).isNull(), t)
    return counted.select(F.coalesce(F.col(key).cast("long"), mark).alias("doc"), mark.alias("mark"), F.col(key).isNotNull().alias("has_id"), F.coalesce(F.col(part), F.lit("")).alias("part"), F.unhex(F.sha2(t.cast("binary"), 256)).alias("digest"), failed.alias("failed"))


def repeats(rows: DataFrame) -> DataFrame:
    """(doc, mark) of the rows of ``judged`` whose text a smaller id has too; null ids are neither smaller nor larger.

    The smallest id of each text comes from an aggregate with partial sums; only texts of several ids are joined back.
    """
    first = rows.where("has_id").groupBy("digest").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).where("first < last").drop("last")
    return rows.where("has_id").join(first, "digest").where("doc > first").select("doc", "mark")


def failing(rows: DataFrame) -> DataFrame:
    """The failing-id relations of ``judged`` rows in one stored table (filter, doc, mark), a folder for each filter."""
    own = rows.select(F.explode("failed").alias("filter"), "doc", "mark")
    return own.unionByName(repeats(rows).select(F.lit("E").alias("filter"), "doc", "mark"))


def _labels(labels: DataFrame, key: str) -> DataFrame:
    one = lambda c: F.coalesce(F.max(F.when(F.col(c) == 1, 1)), F.lit(0))
    return labels.where(F.col(key).isNotNull()).groupBy(F.col(key).cast("long").alias("_doc")).agg(one("quality").alias("good"), one("toxic").alias("toxic"))


def removals(rows: DataFrame, fails: DataFrame, labels: DataFrame, letters: str, key: str = "doc_id") -> DataFrame:
    """(part, prefix, next, removed, good, toxic): what the filter with bit ``next`` takes from the survivors of a prefix.

    Prefixes are bit sets of the letters. Failing documents are dealt out by id once; the rows for their prefixes are
    made, joined and counted where they are.
    """
    n = len(letters)
    bit = F.call_function("shiftleft", F.lit(1), F.instr(F.lit(letters), F.col("filter")) - 1)
    relation = fails.select(F.col("doc").alias("_d"), F.col("mark").alias("_m"), bit.alias("_bit"))
    same = (F.col("doc") == F.col("_d")) & (F.col("mark") == F.col("_m"))
    bad = rows.join(relation, same, "left_semi").select("doc", "mark", "has_id", "part")
    bad = bad.join(_labels(labels, key), (F.col("doc") == F.col("_doc")) & F.col("has_id"), "left")
    bad = bad.select("doc", "mark", "part", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic")).repartition("doc", "mark")
    each = bad.withColumn("prefix", F.explode(F.sequence(F.lit(0), F.lit(2**n - 1))))
    survivors = each.join(relation, same & (F.col("prefix").bitwiseAND(F.col("_bit")) != 0), "left_anti")
    following = F.filter(F.array(*[F.lit(1 << i) for i in range(n)]), lambda b: F.col("prefix").bitwiseAND(b) == 0)
    taken = survivors.withColumn("next", F.explode(following)).join(relation, same & (F.col("next").bitwiseAND(F.col("_bit")) != 0), "left_semi")
    return taken.groupBy("part", "prefix", "next").agg(F.count(F.lit(1)).alias("removed"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))


def orders(counts: DataFrame, totals: DataFrame, letters: str) -> DataFrame:
    """A row for each part, order of the filters and step, from the rows of ``removals`` and (part, total)."""
    n = len(letters)
    entry = F.struct((F.col("prefix") * 2**n + F.col("next")).alias("key"), F.struct("removed", "good", "toxic").alias("value"))
    held = counts.groupBy(F.col("part").alias("_p")).agg(F.map_from_entries(F.collect_list(entry)).alias("at"))  # n * 2^(n-1) entries at most
    parts = totals.join(held, F.col("part") == F.col("_p"), "left").drop("_p")
    steps = parts.withColumn("filter_order", F.explode(F.array(*[F.lit("".join(p)) for p in permutations(letters)]))).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(n))))
    order = F.col("filter_order")

    def bit(place: Column) -> Column:
        return F.call_function("shiftleft", F.lit(1), F.instr(F.lit(letters), F.substring(order, place, F.lit(1))) - 1)

    def before(place: Column) -> Column:
        return F.aggregate(F.filter(F.sequence(F.lit(0), place - 1), lambda i: i > 0), F.lit(0), lambda a, i: a + bit(i))

    def look(prefix: Column, follows: Column, field: str) -> Column:
        return F.coalesce(F.try_element_at(F.col("at"), prefix * 2**n + follows)[field], F.lit(0)).cast("long")

    own, prefix = bit(F.col("step")), before(F.col("step"))
    gone = F.aggregate(F.sequence(F.lit(1), F.col("step")), F.lit(0).cast("long"), lambda a, i: a + look(before(i), bit(i), "removed"))
    weight = {s: factorial(bin(s).count("1")) * factorial(n - 1 - bin(s).count("1")) for s in range(2**n) if s != 2**n - 1}
    shapley = sum((F.when(F.lit(s).bitwiseAND(own) == 0, look(F.lit(s), own, "removed") * w).otherwise(0) for s, w in weight.items()), F.lit(0))
    out = steps.select("part", "filter_order", "step", "total", "at", own.alias("own"), prefix.alias("prefix"), gone.alias("gone"))
    own, prefix = F.col("own"), F.col("prefix")
    removed = look(prefix, own, "removed")
    return out.select(
        "part", "filter_order", "step", (F.col("total") - F.col("gone")).alias("kept"), removed.alias("removed"), (look(F.lit(0), own, "removed") - removed).alias("redundant"),
        look(F.lit(2**n - 1) - own, own, "removed").alias("unique_fails"), look(prefix, own, "good").alias("good_lost"), look(prefix, own, "toxic").alias("toxic_lost"), shapley.cast("long").alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", part: str = "source", text: str = "text", letters: str = "ABCDE") -> DataFrame:
    """Counts for each part, order of the filters A to E and step of the order; see ``COUNTS``.

    Every row of ``docs`` counts, repeated ones too; rows of equal key and text fail together. Null and empty texts fail A
    alone (and E if a smaller id has one); whole texts are judged, however long. A label counts if any of the id's label
    rows says 1; ids without labels and null ids have none. Counts are zero where nothing is removed, and an empty table has
    no parts and so no rows. Further columns of ``docs`` and ``labels`` are not looked at.
    """
    rows = stored(judged(docs, key, part, text), "audit-rows")
    fails = stored(failing(rows), "audit-fails", "filter")
    totals = rows.groupBy("part").agg(F.count(F.lit(1)).alias("total"))
    return orders(removals(rows, fails, labels, letters, key), totals, letters)
