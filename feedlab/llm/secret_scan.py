"""Secret scan: candidate spans of every text, told apart by how widely their value is owned over the whole corpus.

Candidates of the base kinds are always reported. The value of each candidate is hashed and counted by distinct
repositories and owners over all documents: a value that many owners hold is a copied example, one that few owners hold in
few repositories and that looks random is a live credential. Long mixed runs of letters and digits of no known kind are
candidates too and are reported only if that count finds them live.
"""

from __future__ import annotations

import hashlib
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .common import stored

#: Kinds in the order of their listing; those of BASE are reported whatever their ownership.
KINDS = ("assign", "access", "hex", "opaque")
BASE = KINDS[:3]
_ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Texts without a match of this have no candidates.
ANY = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]|AKIA[A-Z0-9]{16}|[0-9a-f]{24}|[A-Za-z0-9+/_=-]{20}"""
#: (kind, pattern, group that holds the value, least length of the value)
PATTERNS = (("assign", re.compile(_ASSIGN, re.ASCII), 2, 6), ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20), ("hex", re.compile(r"[0-9a-f]+"), 0, 24))
_OPAQUE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
_DUMMY = re.compile(r"example|changeme|placeholder|your|xxxx|12345|abcdef")
SPAN = "array<struct<kind:int,start:int,end:int,value:binary,random:boolean>>"


def _random(value: str) -> bool:
    """Eight different characters at least and none of the usual dummies."""
    return len(set(value)) >= 8 and not _DUMMY.search(value.lower())


def _mixed(value: str) -> bool:
    return len(set(value)) >= 12 and all(any(a <= c <= b for c in value) for a, b in ("az", "AZ", "09"))


def find(text: str) -> list[dict]:
    """Candidates of one text by start and kind; positions are in code points, ends exclusive."""
    out = []

    def add(kind: str, m: re.Match, value: str) -> None:
        digest = hashlib.sha256(value.encode()).digest()[:16]
        out.append({"kind": KINDS.index(kind), "start": m.start(), "end": m.end(), "value": digest, "random": _random(value)})

    for kind, pattern, group, least in PATTERNS:
        for m in pattern.finditer(text):
            if len(m[group]) >= least:
                add(kind, m, m[group])
    taken, at = [], 0  # what the base spans cover, merged
    for x in sorted(out, key=lambda x: x["start"]):
        if taken and x["start"] < taken[-1][1]:
            taken[-1][1] = max(taken[-1][1], x["end"])
        else:
            taken.append([x["start"], x["end"]])
    for m in _OPAQUE.finditer(text):
        while at < len(taken) and taken[at][1] <= m.start():
            at += 1
        free = at == len(taken) or taken[at][0] >= m.end()
        if free and _mixed(m[0]) and _random(m[0]):
            add("opaque", m, m[0])
    return sorted(out, key=lambda x: (x["start"], x["kind"]))


def _find_all(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: find(t) if t else [])


def candidates(docs: DataFrame, key: str, owner: str, text: str) -> DataFrame:
    """(key, doc, mark, owner, spans), one narrow row a document. Only texts that ``ANY`` matches are handed to Python, whole."""
    t = F.coalesce(F.col(text), F.lit(""))
    mark = F.xxhash64(F.col(key).isNull(), t)
    return docs.select(
        F.col(key).alias("key"), F.coalesce(F.col(key).cast("long"), mark).alias("doc"), mark.alias("mark"),
        F.coalesce(F.col(owner), F.lit("")).alias("owner"), pandas_udf(_find_all, SPAN)(F.when(t.rlike(ANY), t)).alias("spans"),
    )


def ownership(found: DataFrame) -> DataFrame:
    """(value, n_repos, n_owners): distinct repositories (documents) and owners of each value, over the whole corpus.

    Distinct (value, owner, repository) come first, so that a value that everybody has is spread over its repositories.
    """
    once = found.select("owner", "doc", "mark", F.explode("spans.value").alias("value")).distinct()
    by_owner = once.groupBy("value", "owner").agg(F.count(F.lit(1)).alias("n"))
    return by_owner.groupBy("value").agg(F.sum("n").alias("n_repos"), F.count(F.lit(1)).alias("n_owners"))


def verdicts(found: DataFrame, own: DataFrame, max_owners: int, max_repos: int, example_owners: int, hot: int = 4096, salts: int = 64) -> DataFrame:
    """(doc, mark, live, examples): values of each document that are live credentials or widely copied examples.

    Values of over ``hot`` repositories are joined under ``salts`` keys each, so that none makes one large key; what they
    leave is joined by value.
    """
    own = own.select("value", (F.col("n_owners") >= example_owners).alias("copied"), ((F.col("n_owners") <= max_owners) & (F.col("n_repos") <= max_repos)).alias("own"), "n_repos").where("copied OR own")
    rows = found.select("doc", "mark", F.explode("spans").alias("s")).select("doc", "mark", "s.value", "s.random").withColumn("salt", F.pmod(F.col("mark"), F.lit(salts)))
    often = own.where(F.col("n_repos") > hot).select(F.col("value").alias("_v"), "copied", "own", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt"))
    split = rows.join(often, (F.col("value") == F.col("_v")) & (F.col("salt") == F.col("_salt")), "left").drop("_salt", "salt")
    seldom = own.where(F.col("n_repos") <= hot).drop("n_repos")
    known = split.where("_v IS NOT NULL").drop("_v").unionByName(split.where("_v IS NULL").drop("_v", "copied", "own").join(seldom, "value"))
    # an owner's own value is live only if it looks random; a set holds a value once, however often it stands in a text
    return known.groupBy("doc", "mark").agg(F.collect_set(F.when(F.col("own") & F.col("random"), F.col("value"))).alias("live"), F.collect_set(F.when(F.col("copied"), F.col("value"))).alias("examples"))


def listed(spans: Column) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, key: str = "doc_id", owner: str = "source", text: str = "text", max_owners: int = 2, max_repos: int = 20, example_owners: int = 10) -> DataFrame:
    """(key, base, added, n_live, n_examples): spans of the base kinds, spans that ownership adds, and how many are live or copied.

    A document is a repository of its owner. Live: at most ``max_owners`` owners and ``max_repos`` repositories, and a
    random look; copied: ``example_owners`` or more. One row in, one row out, repeated rows too (a repeated row is one
    repository). Null, empty and blank texts have no spans; texts are read whole. Spans of equal start are listed by kind. A
    null owner is an owner, null keys are told apart by their text. Further columns are not looked at; an empty table gives none.
    """
    found = stored(candidates(docs, key, owner, text), "secrets-found")
    told = verdicts(found, ownership(found), max_owners, max_repos, example_owners)
    out = found.join(told.withColumnsRenamed({"doc": "_d", "mark": "_m"}), (F.col("doc") == F.col("_d")) & (F.col("mark") == F.col("_m")), "left")
    none = F.array().cast("array<binary>")
    live, copied = F.coalesce("live", none), F.coalesce("examples", none)
    is_base = lambda s: s["kind"] < len(BASE)
    count = lambda keep: F.size(F.filter("spans", keep)).cast("long")
    return out.select(
        F.col("key").alias(key), F.filter("spans", is_base).alias("base"), F.filter("spans", lambda s: ~is_base(s) & F.array_contains(live, s["value"])).alias("added"),
        count(lambda s: s["random"] & F.array_contains(live, s["value"])).alias("n_live"), count(lambda s: is_base(s) & F.array_contains(copied, s["value"])).alias("n_examples"),
    )
