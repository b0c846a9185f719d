"""Quality rules: base statistics of a text, and removal of lines that recur across a host's documents.

Lines are normalised and hashed; for each host (the ``source`` column) the distinct documents that hold a line are
counted. Lines above the limits are boilerplate and go; a document that loses more than half of its words to that is
depleted and rejected. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, let, stored, words

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50


def _count_chars(text: Column, chars: str) -> Column:
    """How often the given ASCII characters occur."""
    total = F.lit(0)
    for c in chars:
        total = total + F.octet_length(text) - F.octet_length(F.replace(text, F.lit(c), F.lit("")))
    return total.cast("long")


def _repeat_words(w: Column) -> Column:
    """Words inside three-word windows that occur twice or more in the text, the first occurrence included."""
    n = F.size(w)
    hashes = F.transform(F.sequence(F.lit(1), n - 2), lambda i: F.xxhash64(F.element_at(w, i), F.element_at(w, i + 1), F.element_at(w, i + 2)))

    def covered(h: Column) -> Column:
        order = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def starts(s: Column) -> Column:
            same = lambda x, k: F.coalesce(F.get(s, k)["h"] == x["h"], F.lit(False))
            return F.transform(F.filter(s, lambda x, k: same(x, k - 1) | same(x, k + 1)), lambda x: x["i"])

        spans = F.flatten(F.transform(let(order, starts), lambda i: F.array(i, i + 1, i + 2)))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(F.size(F.array_distinct(spans)))

    return F.when(n < 3, F.lit(0)).otherwise(let(hashes, covered)).cast("long")


def with_base(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed; one row in, one row out.

    Null and blank texts have no words and fail; repeated rows get equal values; an empty table stays empty; columns of
    ``df`` named like the new ones are replaced.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    w = words(F.col(text))
    full_lines = F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    out = df.withColumns({
        "n_words": let(w, lambda x: F.struct(F.size(x).cast("long").alias("n"), _repeat_words(x).alias("r"))),
        "word_chars": F.char_length(t).cast("long") - _count_chars(t, SPACES),
        "n_symbols": _count_chars(t, SYMBOLS),
        "n_dup_lines": let(full_lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
    })
    out = out.withColumns({"n_repeat_words": F.col("n_words.r"), "n_words": F.col("n_words.n")})
    return out.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def _normal(line: Column) -> Column:
    return F.lower(F.regexp_replace(F.btrim(line, F.lit(SPACES)), r"[\x20\x09-\x0D]+", " "))


def _lines(text: Column) -> Column:
    """(line hash, words) of each line of a text that holds a word."""
    full = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), _normal), lambda x: x != "")
    return F.transform(full, lambda y: F.struct(F.xxhash64(y).alias("line"), F.size(F.split(y, " ")).alias("n")))


def _marked_lines(text: Column) -> Column:
    """(line hash, words, ends) of each different line: ``ends`` are hashes of its first and of its last words, by which an edited line is known.

    Three words from six on, two from three on; shorter lines have no ends.
    """
    full = F.array_distinct(F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), _normal), lambda x: x != ""))

    def row(y: Column, w: Column) -> Column:
        n = F.size(w)
        few = F.when(n >= 6, 3).otherwise(2)
        end = lambda tag, first: F.xxhash64(F.lit(tag), F.array_join(F.slice(w, first, few), " "))
        return F.struct(F.xxhash64(y).alias("line"), n.alias("n"), F.when(n >= 3, F.array(end("first", F.lit(1)), end("last", n - few + 1))).otherwise(F.array().cast("array<bigint>")).alias("ends"))

    return F.transform(full, lambda y: let(F.split(y, " "), lambda w: row(y, w)))


#: Most boilerplate lines whose hashes are handed to the executors as one literal set (8 bytes each); more are joined.
LITERAL_LINES = 50_000
#: A text with a smaller share of words of its own than one in OWN_SHARE is a near copy.
OWN_SHARE = 10


def _kinds(texts: DataFrame, often: DataFrame) -> DataFrame:
    """(host, hits, kind) of each text with lines in ``often``: those lines, and the hash of the set of its own lines.

    Own lines are those that are neither in ``often`` nor, by one of their ends, an edited form of such a line. ``kind`` is
    null where they have less than a tenth of the words: such a text is a near copy of others.
    """

    def kind(lines: Column, words: Column, total: Column) -> Column:
        return F.when((words > 0) & (words * OWN_SHARE >= total), F.xxhash64(F.sort_array(lines)))

    if often.count() <= LITERAL_LINES:
        found = often.select(F.xxhash64("host", "line"), F.transform("ends", lambda e: F.xxhash64(F.col("host"), e))).collect()  # bounded by LITERAL_LINES
        lines, ends = sorted({r[0] for r in found}), sorted({e for r in found for e in r[1]})
        known = lambda x: F.xxhash64(F.col("host"), x["line"]).isin(lines) if lines else F.lit(False)
        edited = lambda x: F.exists(x["ends"], lambda e: F.xxhash64(F.col("host"), e).isin(ends)) if ends else F.lit(False)
        split = texts.select("host", "lines", F.filter("lines", known).alias("hit")).where(F.size("hit") > 0)
        split = split.withColumn("own", F.filter("lines", lambda x: ~known(x) & ~edited(x)))
        count = lambda c: F.aggregate(c, F.lit(0), lambda a, x: a + x["n"])
        return split.select("host", F.transform("hit", lambda x: x["line"]).alias("hits"), kind(F.transform("own", lambda x: x["line"]), count("own"), count("lines")).alias("kind"))
    same = lambda a, b, *more: a.join(b, [a["host"].eqNullSafe(b["_h"]), *more], "left")
    each = texts.select("host", "t", F.explode("lines").alias("x")).select("host", "t", "x.*")
    each = same(each, often.select(F.col("host").alias("_h"), F.col("line").alias("_l")), F.col("line") == F.col("_l")).withColumn("known", F.col("_l").isNotNull()).drop("_h", "_l")
    cuts = often.select(F.col("host").alias("_h"), F.explode("ends").alias("_e")).distinct()
    near = each.where("NOT known").select("host", "t", "line", F.explode("ends").alias("end"))
    near = near.join(cuts, near["host"].eqNullSafe(cuts["_h"]) & (F.col("end") == F.col("_e"))).select(F.col("host").alias("_h"), F.col("t").alias("_t"), F.col("line").alias("_l")).distinct()
    each = same(each, near, F.col("t") == F.col("_t"), F.col("line") == F.col("_l")).withColumn("own", ~F.col("known") & F.col("_l").isNull())
    by_text = each.groupBy("host", "t").agg(F.collect_list(F.when(F.col("known"), F.col("line"))).alias("hits"), F.collect_list(F.when(F.col("own"), F.col("line"))).alias("own"), F.sum(F.when(F.col("own"), F.col("n")).otherwise(0)).alias("words"), F.sum("n").alias("total"))
    return by_text.where(F.size("hits") > 0).select("host", "hits", kind(F.col("own"), F.col("words"), F.col("total")).alias("kind"))


def boilerplate(df: DataFrame, host: str = "source", text: str = "text", min_docs: int = 20, max_share: float = 0.01, max_docs: int = 100) -> DataFrame:
    """(host, line) of the boilerplate lines of each host; see ``with_line_verdict``.

    Null and empty texts have no lines, a null host is a host, repeated rows and equal texts count once, an empty table has
    no boilerplate, and further columns are not looked at. One pass over the texts, of which hashes alone are shuffled.
    """
    texts = df.select(F.col(host).alias("host"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("t"), _marked_lines(F.col(text)).alias("lines")).where(F.size("lines") > 0)
    texts = stored(texts.dropDuplicates(["host", "t"]), "quality-texts")
    sizes = df.groupBy(F.col(host).alias("_h")).agg(F.count(F.lit(1)).alias("n_host"))
    each = texts.select("host", F.explode("lines").alias("x")).select("host", "x.line", "x.ends")
    often = stored(each.groupBy("host", "line").agg(F.count(F.lit(1)).alias("n"), F.first("ends").alias("ends")).where(F.col("n") > min_docs), "quality-often")
    held = _kinds(texts, often).select("host", "kind", F.explode("hits").alias("line")).groupBy("host", "line").agg(F.count_distinct("kind").alias("kinds"), F.count_if(F.col("kind").isNull()).alias("copies"))
    # near copies are one kind; one in ten of them may have got lines of its own by chance
    documents = F.col("kinds") + F.least("copies", F.lit(1)) - F.col("copies") / OWN_SHARE
    rows = held.withColumn("documents", documents).where(F.col("documents") > min_docs)
    rows = rows.join(sizes, F.col("host").eqNullSafe(F.col("_h")))
    return rows.where((F.col("documents") > max_docs) | (F.col("documents") > max_share * F.col("n_host"))).select("host", "line")


def with_line_verdict(df: DataFrame, host: str = "source", key: str = "doc_id", text: str = "text", max_removed: float = 0.5, **limits) -> DataFrame:
    """``df`` with ``boiler`` (hashes of the row's boilerplate lines), ``n_boiler_words`` and ``depleted``.

    A line is boilerplate if more than ``max_docs`` documents of its host hold it, or more than ``min_docs`` and
    ``max_share`` of them. Copies and near copies of one text count as one document: documents are told apart by the set of
    their own lines, which are not themselves held by more than ``min_docs`` and don't begin or end as such a line does, and
    a text with less than a tenth of its words in own lines (as texts of similarity 0.8 have) is a near copy.

    Every row is a document, repeated rows too, and none is dropped. Lines of any length are counted, without regard to
    case and to the amount of white space; null, empty and blank texts have none. A null host is a host like any other.
    A count equal to a limit is not above it. An empty table stays empty. Columns of ``df`` named like the new ones are
    replaced.
    """
    found = stored(boilerplate(df, host, text, **limits), "quality-boilerplate")
    base = df.drop("boiler", "n_boiler_words", "depleted")
    own = _lines(F.col(text))
    if found.count() <= LITERAL_LINES:
        known = [r[0] for r in found.select(F.xxhash64("host", "line")).collect()]  # bounded by LITERAL_LINES
        hit = F.filter(own, lambda x: F.xxhash64(F.col(host), x["line"]).isin(known)) if known else F.array().cast("array<struct<line:bigint,n:int>>")
        out = base.withColumn("_hit", hit)
    else:
        text_hash = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
        rows = base.select(F.col(key).alias("_k"), F.col(host).alias("_h"), text_hash.alias("_t"), F.explode(own).alias("x")).join(found, F.col("_h").eqNullSafe(F.col("host")) & (F.col("x.line") == F.col("line")), "left_semi")
        lost = rows.groupBy("_k", "_h", "_t").agg(F.collect_set("x.line").alias("_found"))
        same = F.col("_k").eqNullSafe(base[key]) & F.col("_h").eqNullSafe(base[host]) & (F.col("_t") == F.xxhash64(F.coalesce(base[text], F.lit(""))))
        out = base.join(lost, same, "left").drop("_k", "_h", "_t").withColumn("_hit", F.when(F.col("_found").isNotNull(), F.filter(own, lambda x: F.array_contains("_found", x["line"])))).drop("_found")
    words_lost = F.coalesce(F.aggregate("_hit", F.lit(0), lambda a, x: a + x["n"]), F.lit(0)).cast("long")
    out = out.withColumns({"boiler": F.when(F.size("_hit") > 0, F.array_distinct(F.transform("_hit", lambda x: x["line"]))), "n_boiler_words": words_lost}).drop("_hit")
    return out.withColumn("depleted", F.col("n_boiler_words") > max_removed * F.col("n_words"))


def judge(df: DataFrame, host: str = "source", key: str = "doc_id", text: str = "text", **limits) -> DataFrame:
    """``df`` with the base statistics, the line verdict and ``kept``: neither failed nor depleted.

    One row in, one row out; see ``with_base`` and ``with_line_verdict`` for nulls, empties, ties and repeated rows.
    """
    out = with_line_verdict(with_base(df, text), host, key, text, **limits)
    return out.withColumn("kept", ~F.col("base_failed") & ~F.col("depleted"))


def without_boilerplate(judged: DataFrame, text: str = "text") -> DataFrame:
    """Rows of ``judge`` with their boilerplate lines taken out of the text; other texts, null ones too, stay as they are."""
    rest = F.array_join(F.filter(F.split(F.col(text), "\n"), lambda x: ~F.array_contains("boiler", F.xxhash64(_normal(x)))), "\n")
    return judged.withColumn(text, F.when(F.col("boiler").isNull(), F.col(text)).otherwise(rest))
