"""URL filtering: longest-match host/path rules over an exact block list held as a cascade of Bloom filters.

Level 1 encodes the listed hosts. The hosts of the corpus that are not listed and yet pass level 1 are encoded in level
2, the listed hosts that pass level 2 in level 3, and so on until no level has false positives left. The universe is
complete (every host that occurs), so the answer for any host of the corpus is exact: it is listed if and only if the
first level that rejects it is an even one. Judging a row is then a few bit tests; no join and no shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, stored

#: Levels after which building gives up: each level has about 1/40 of the keys two levels above it.
MAX_LEVELS = 64


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for null or without ``://``."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty for null or without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def longest_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting rule, null where none fits.

    ``rules`` has (``host/path``, ``allow`` or ``block``). A rule fits its host and all subdomains if the path starts
    with the rule's path (which begins at the first ``/``). The rule list is code, so of fixed size.
    """
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, what in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        name, _, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


@dataclass(frozen=True)
class Level:
    bits: np.ndarray  # uint64 words
    n_bits: int
    n_hashes: int


def _hashes(key: Column) -> tuple[Column, Column]:
    return F.xxhash64(key), F.xxhash64(F.lit("second"), key)


def _positions(h1: np.ndarray, h2: np.ndarray, level: Level, i: int) -> np.ndarray:
    return (h1.view(np.uint64) + np.uint64(i) * h2.view(np.uint64)) % np.uint64(level.n_bits)


def passes(h1: np.ndarray, h2: np.ndarray, level: Level) -> np.ndarray:
    """Which of the hashed keys one level's filter lets pass."""
    ok = np.ones(len(h1), bool)
    for i in range(level.n_hashes):
        at = _positions(h1, h2, level, i)
        ok &= (level.bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1
    return ok


def _fit(keys: DataFrame, n: int, bits_per_key: float, n_hashes: int, depth: int) -> Level:
    """One filter over the columns h1, h2 of ``keys``; words of bits are or-ed by Spark and only they reach the driver.

    Sizes differ by level, so keys that share all their bits in one level seldom do in another.
    """
    n_bits = (max(16, int(n * bits_per_key) // 64 + 1) + depth) * 64
    m = F.lit(n_bits).cast("decimal(20,0)")
    two64 = F.lit("18446744073709551616").cast("decimal(38,0)")
    at = []
    for i in range(n_hashes):  # the sum wraps as in uint64; the remainder is that of the unsigned value
        s = F.expr(f"CAST((CAST(h1 AS DECIMAL(38,0)) + {i} * CAST(h2 AS DECIMAL(38,0))) AS DECIMAL(38,0))")
        at.append(F.pmod(F.pmod(s, two64), m).cast("long"))
    words = keys.select(F.explode(F.array(*at)).alias("at")).groupBy(F.expr("at DIV 64").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(at % 64 AS INT))")).alias("bits"))
    got = words.toPandas()
    bits = np.zeros(n_bits // 64, np.int64)
    bits[got["word"].to_numpy(np.int64)] = got["bits"].to_numpy(np.int64)
    return Level(bits.view(np.uint64), n_bits, n_hashes)


def _passing(df: DataFrame, level: Level) -> DataFrame:
    b = df.sparkSession.sparkContext.broadcast(level)

    @F.pandas_udf("boolean")
    def test(h1: pd.Series, h2: pd.Series) -> pd.Series:
        return pd.Series(passes(h1.to_numpy(np.int64), h2.to_numpy(np.int64), b.value))

    return df.where(test("h1", "h2"))


@dataclass(frozen=True)
class Cascade:
    levels: tuple[Level, ...]

    @property
    def n_bytes(self) -> int:
        return sum(x.bits.nbytes for x in self.levels)

    def contains(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """Exact for every key of the universe that the cascade was built over."""
        out, open_ = np.full(len(h1), len(self.levels) % 2 == 1), np.ones(len(h1), bool)
        for k, level in enumerate(self.levels):
            ok = passes(h1, h2, level)
            out[open_ & ~ok] = k % 2 == 1
            open_ &= ok
        return out


def build_cascade(universe: DataFrame, bits_per_key: float = 12.0, n_hashes: int = 6, max_bytes: int = 256 << 20) -> Cascade:
    """Cascade over ``universe`` (key string, listed boolean): every key of the corpus once.

    The filters are broadcast, so their size is checked: above ``max_bytes`` ValueError is raised before anything is
    collected. ``judge`` splits the keys so that this does not happen.
    """
    h1, h2 = _hashes(F.col("key"))
    keys = stored(universe.select("listed", h1.alias("h1"), h2.alias("h2")), "cascade-universe")
    encode, others = keys.where("listed").select("h1", "h2"), keys.where("NOT listed").select("h1", "h2")
    levels: list[Level] = []
    while len(levels) < MAX_LEVELS:
        n = encode.count()
        if n == 0 and levels:
            return Cascade(tuple(levels))
        if sum(x.bits.nbytes for x in levels) + n * bits_per_key / 8 > max_bytes:
            raise ValueError(f"the cascade needs more than {max_bytes} bytes; split its keys")
        level = _fit(encode, n, bits_per_key, n_hashes, len(levels))
        levels.append(level)
        encode, others = stored(_passing(others, level), "cascade-level"), encode
    raise ValueError("two keys have the same pair of 64-bit hashes")


def _member(df: DataFrame, cascade: Cascade):
    b = df.sparkSession.sparkContext.broadcast(cascade)

    @F.pandas_udf("boolean")
    def member(h1: pd.Series, h2: pd.Series) -> pd.Series:
        return pd.Series(b.value.contains(h1.to_numpy(np.int64), h2.to_numpy(np.int64)))

    return member


def n_parts(n_keys: float, bits_per_key: float, max_bytes: int) -> int:
    """Parts into which the keys are split so that each part's cascade stays below half of ``max_bytes``."""
    return int(2 * n_keys * bits_per_key / 8 // max_bytes) + 1


def judge(pages: DataFrame, listed: DataFrame, rules: list[tuple[str, str]], url: str = "url", parts: int | None = None, bits_per_key: float = 12.0, max_bytes: int = 64 << 20) -> DataFrame:
    """``pages`` with host, path, rule and verdict (``allow`` or ``block``).

    ``listed`` has the blocked hosts in a column ``key``, lower-case; repeated and null ones count once and not at all. A
    fitting rule decides; else listed hosts are blocked. The keys are split by hash into ``parts`` (by default as many as
    the number of listed hosts of the corpus asks for), each with a cascade of its own, and the cascades are broadcast
    one by one: no broadcast passes ``max_bytes``, however long the list is.

    Null urls and urls without ``://`` have an empty host, which is judged like any other; repeated rows get equal
    verdicts; an empty table stays empty; columns of ``pages`` named like the new ones are replaced.
    """
    base = pages.drop(*[c for c in ("host", "path", "rule", "verdict") if c != url]).withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})
    tagged = base.select(F.col("host").alias("key")).distinct().withColumns({"here": F.lit(True), "listed": F.lit(False)}).unionByName(listed.select("key").where("key IS NOT NULL").withColumns({"here": F.lit(False), "listed": F.lit(True)}))
    universe = stored(tagged.groupBy("key").agg(F.max("here").alias("here"), F.max("listed").alias("listed")).where("here").drop("here"), "cascade-hosts")
    size = universe.agg(F.count_if("listed").alias("listed"), F.count_if(~F.col("listed")).alias("rest")).first()
    parts = parts or n_parts(1.1 * size["listed"] + 0.01 * size["rest"], bits_per_key, max_bytes)  # a level lets well under 1 % of the others pass
    part = lambda key: F.pmod(F.xxhash64(F.lit("part"), F.col(key)), F.lit(parts))
    rule, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    base, out = base.withColumns({"rule": rule, "_fixed": verdict}), None
    for k in range(parts):
        cascade = build_cascade(universe.where(part("key") == k) if parts > 1 else universe, bits_per_key, max_bytes=max_bytes)
        rows = base.where(part("host") == k) if parts > 1 else base  # so that a task holds the cascade of its part alone
        rows = rows.withColumn("_listed", _member(pages, cascade)(*_hashes(F.col("host"))))
        out = rows if out is None else out.unionByName(rows)
    return out.withColumn("verdict", F.coalesce("_fixed", F.when(F.col("_listed"), "block").otherwise("allow"))).drop("_fixed", "_listed")
