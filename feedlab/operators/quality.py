"""Schema, null and domain checks; quarantine; exact duplicates and conflicts; set operations."""

from __future__ import annotations

import hashlib
import json
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class UncleanRows(ValueError):
    """A strict run met rows that break a rule."""


def schema_diff(df: DataFrame, expected: StructType) -> DataFrame:
    """(column, problem, expected, found) for missing, wrongly typed and unexpected columns."""
    have = {f.name: f.dataType.simpleString() for f in df.schema}
    want = {f.name: f.dataType.simpleString() for f in expected}
    rows = [(c, "missing", want[c], None) for c in want if c not in have]
    rows += [(c, "wrong type", want[c], have[c]) for c in want if c in have and have[c] != want[c]]
    rows += [(c, "unexpected", None, have[c]) for c in have if c not in want]
    return df.sparkSession.createDataFrame(rows, "column string, problem string, expected string, found string")


def null_profile(df: DataFrame) -> DataFrame:
    """(column, nulls): one aggregation, turned upright."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    return counts.select(F.explode(F.map_from_arrays(F.array(*[F.lit(c) for c in df.columns]), F.array(*df.columns))).alias("column", "nulls"))


def type_mix(df: DataFrame, kind: str) -> DataFrame:
    """Rows of each kind; nulls are a kind of their own."""
    return df.groupBy(F.coalesce(kind, F.lit("(null)")).alias(kind)).agg(F.count(F.lit(1)).alias("n_rows"))


def reasons(rules: dict[str, Column]) -> Column:
    """Names of the rules that a row breaks (a rule is true for bad rows; unknown counts as broken)."""
    return F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(True)), F.lit(name)) for name, bad in rules.items()]))


def quarantine(df: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(good rows, bad rows with ``reasons``)."""
    judged = df.withColumn("reasons", reasons(rules))
    return judged.where(F.size("reasons") == 0).drop("reasons"), judged.where(F.size("reasons") > 0)


def require_clean(bad: DataFrame) -> None:
    """Raise UncleanRows where a quarantine holds any row."""
    if not bad.isEmpty():
        raise UncleanRows(f"rows break the rules: {bad.select('reasons').first()[0]}")


def eligible(df: DataFrame, required: list[str], *also: Column) -> DataFrame:
    """Rows whose required columns are all set and that meet the conditions."""
    return df.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in required] + list(also)))


def eligibility_census(df: DataFrame, by: str, required: list[str], *also: Column) -> DataFrame:
    """(by, n_rows, n_eligible)."""
    ok = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in required] + list(also))
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(ok).alias("n_eligible"))


def late_features(df: DataFrame, cutoff: str, available: list[str]) -> DataFrame:
    """Rows with a feature that was not available at the cutoff, and which; a feature without a time is late too."""
    bad = {c: F.col(c) > F.col(cutoff) for c in available}
    return df.withColumn("late", reasons(bad)).where(F.size("late") > 0)


def pit_filter(df: DataFrame, cutoff: str, available: list[str]) -> DataFrame:
    """Rows whose features were all available at the cutoff."""
    return df.where(reduce(lambda a, b: a & b, [F.col(c) <= F.col(cutoff) for c in available]))


def dedupe_exact(df: DataFrame, content: list[str], order: list[str]) -> DataFrame:
    """First row of each content, with ``had_duplicates``; ties are decided by ``order``."""
    w = Window.partitionBy(*content)
    return df.withColumns({"_nth": F.row_number().over(w.orderBy(*order)), "_all": F.count(F.lit(1)).over(w)}).where("_nth = 1").withColumn("had_duplicates", F.col("_all") > 1).drop("_nth", "_all")


#: Rows that a task groups by id, on average.
ROWS_A_TASK = 500_000


def id_conflicts(df: DataFrame, key: list[str], content: list[str]) -> DataFrame:
    """Per id: rows, exact repeats and whether different contents claim it; ids that occur once are left out.

    Ids are nearly as many as rows, so a task's share of them is what it holds in memory. They are dealt out to as many
    tasks as the rows ask for, before they are counted.
    """
    rows = df.select(*key, F.xxhash64(*content).alias("_h"))
    tasks = max(-(-df.count() // ROWS_A_TASK), df.sparkSession.sparkContext.defaultParallelism)
    each = rows.repartition(tasks, *[F.col(k) for k in key]).groupBy(*key, "_h").agg(F.count(F.lit(1)).alias("_n"))
    counts = each.groupBy(*key).agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n_rows"), F.count(F.lit(1)).alias("n_contents"))
    return counts.where("n_rows > 1").withColumn("conflict", F.col("n_contents") > 1)


def union_by_name(*parts: DataFrame) -> DataFrame:
    """All rows; columns that a part lacks are null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def missing_keys(expected: DataFrame, observed: DataFrame, keys: list[str]) -> DataFrame:
    """Expected keys that were not observed."""
    return expected.select(*keys).distinct().join(observed.select(*keys).distinct(), keys, "left_anti")


def overlap(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that both hold; two splits are disjoint if none."""
    return a.select(*keys).intersect(b.select(*keys))


def two_run_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that only one of two runs has, with ``run``; none if the runs are equal."""
    return a.exceptAll(b).withColumn("run", F.lit("first")).unionByName(b.exceptAll(a).withColumn("run", F.lit("second")))


def constant_in_group(df: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """Per key, for each column whether it has one value only (null is a value)."""
    same = [(F.min(c).eqNullSafe(F.max(c)) & ((F.count(c) == 0) | (F.count(c) == F.count(F.lit(1))))).alias(c) for c in columns]
    return df.groupBy(*key).agg(*same)


def partition_audit(df: DataFrame, season: Column, key: str, kind: str) -> DataFrame:
    """Per season: rows, distinct keys, whether keys are unique, kinds in order."""
    return df.groupBy(season.alias("season")).agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct(key).alias("n_keys"), (F.count_distinct(key) == F.count(F.lit(1))).alias("unique_keys"), F.array_join(F.array_sort(F.collect_set(kind)), ",").alias("kinds"))


def unordered_pairs(df: DataFrame, left: str, right: str) -> DataFrame:
    """(low, high, n) of pairs whatever their order."""
    return df.groupBy(F.least(left, right).alias("low"), F.greatest(left, right).alias("high")).agg(F.count(F.lit(1)).alias("n"))


#: Names of the kinds of JSON values, by how the type of a variant begins.
_JSON_KINDS = {"OBJECT": "object", "ARRAY": "array", "STRING": "string", "BOOLEAN": "boolean", "VOID": "null", "BIGINT": "integer", "DECIMAL": "number", "DOUBLE": "number", "FLOAT": "number"}


def json_types(df: DataFrame, by: str, text: str, depth: int = 8) -> DataFrame:
    """``by``, ``path`` and the sorted set ``types`` of the values at that path in the JSON texts of all rows, nested ones included.

    Texts are parsed to variants, and each level of nesting is exploded beside its own row, down to ``depth`` levels (what
    is deeper counts as the object or array that it is in). A null text is ``missing``, one that is no JSON ``invalid``.
    """
    doc = F.try_parse_json(text)
    rows = df.select(F.col(by), F.lit("$").alias("path"), doc.alias("_v"), F.when(F.col(text).isNull(), "missing").when(doc.isNull(), "invalid").alias("type"), F.lit(True).alias("_new"))
    kind = F.regexp_extract(F.schema_of_variant("_v"), "^[A-Z]+", 0)
    names = F.create_map(*[F.lit(x) for pair in _JSON_KINDS.items() for x in pair])
    spark = df.sparkSession
    for _ in range(depth):
        rows = rows.withColumn("_go", F.explode(F.array(F.lit(False), F.lit(True)))).where("NOT _go OR (_new AND _v IS NOT NULL)")
        inner = spark.tvf.variant_explode_outer(F.when(F.col("_go"), F.col("_v")).outer()).select(F.col("key").alias("_key"), F.col("value").alias("_value"), F.col("pos").alias("_pos"))
        both = rows.lateralJoin(inner).where("NOT _go OR _pos IS NOT NULL")
        path = F.when(F.col("_key").isNull(), F.concat("path", F.lit("[]"))).otherwise(F.concat("path", F.lit("."), "_key"))
        go = F.col("_go")
        rows = both.select(by, F.when(go, path).otherwise(F.col("path")).alias("path"), F.when(go, F.col("_value")).otherwise(F.col("_v")).alias("_v"), F.when(~go, F.col("type")).alias("type"), go.alias("_new"))
    return rows.select(by, "path", F.coalesce("type", F.try_element_at(names, kind), kind).alias("type")).groupBy(by, "path").agg(F.sort_array(F.collect_set("type")).alias("types"))


def json_schemas(df: DataFrame, by: str, text: str) -> DataFrame:
    """Per group: rows, missing and invalid texts, the merged schema of the others as variants, and its fingerprint."""
    doc = F.try_parse_json(text)
    merged = df.select(by, doc.alias("_v"), F.col(text).isNull().alias("_missing")).groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.count_if("_missing").alias("missing"), F.count_if(~F.col("_missing") & F.col("_v").isNull()).alias("invalid"), F.schema_of_variant_agg("_v").alias("schema"))
    return merged.withColumn("fingerprint", F.sha2(F.col("schema").cast("binary"), 256))


def schema_fingerprint(schema: StructType) -> str:
    """SHA-256 of the names, types and nullability of a schema's fields, in order."""
    fields = [{"name": f.name, "nullable": f.nullable, "type": f.dataType.simpleString()} for f in schema.fields]
    return hashlib.sha256(json.dumps(fields, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
