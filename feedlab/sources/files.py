"""Readers of captured files with explicit schemas: manifests, raw segments, seasons, matches, rows, races, pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.quality import reasons

SEGMENT = "capture_session_id string, record_ordinal long, receive_at timestamp, payload_base64 string, payload_sha256 string"
MANIFEST = "source string, stream string, session string, date string, hour int, record_count long, first_ordinal long, last_ordinal long, first_receive_at timestamp, last_receive_at timestamp, object_sha256 string, object_size_bytes long, sealed_at timestamp"
MATCH = "match_id long, match_date string, kick_off string, home_team struct<home_team_id:long,home_team_name:string>, away_team struct<away_team_id:long,away_team_name:string>, home_score int, away_score int"
EVENT = """id string, index long, period int, timestamp string, minute int, second int, type struct<id:long,name:string>, team struct<id:long,name:string>, possession long,
possession_team struct<id:long,name:string>, player struct<id:long,name:string>, location array<double>, shot struct<outcome:struct<name:string>>,
bad_behaviour struct<card:struct<name:string>>, foul_committed struct<card:struct<name:string>>, substitution struct<replacement:struct<id:long>>"""
PAIR = "pair_id string, left_market_id string, right_market_id string, relation_type string, confidence string, router_version string, observed_at string"


def read_raw_segments(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """(records with binary payload, bad records with reasons) below source=/stream=/date=/hour=.

    The payload must have its recorded hash, ordinals of a session must be contiguous, and the receive hour that of the folder.
    """
    raw = spark.read.schema(f"{SEGMENT}, source string, stream string, date date, hour int").json(root)
    w = Window.partitionBy("source", "stream", "capture_session_id").orderBy("record_ordinal")
    rows = raw.withColumns({"payload": F.unbase64("payload_base64"), "_before": F.lag("record_ordinal").over(w)})
    rules = {
        "hash": F.sha2("payload", 256) != F.regexp_replace("payload_sha256", "^sha256:", ""),
        "ordinal": F.col("_before").isNotNull() & (F.col("record_ordinal") != F.col("_before") + 1),
        "hour": (F.to_date("receive_at") != F.col("date")) | (F.hour("receive_at") != F.col("hour")),
    }
    judged = rows.withColumn("reasons", reasons(rules)).drop("_before", "payload_base64")
    return judged.where(F.size("reasons") == 0).drop("reasons"), judged.where(F.size("reasons") > 0)


def read_manifests(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """(manifests, those whose folder names differ from their content)."""
    rows = spark.read.schema(MANIFEST).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(root).withColumn("path", F.input_file_name())
    part = lambda n: F.regexp_extract("path", rf"/{n}=([^/]+)/", 1)
    same = (part("source") == F.col("source")) & (part("stream") == F.col("stream")) & (part("date") == F.col("date")) & (part("hour").try_cast("int") == F.col("hour"))
    return rows.where(F.coalesce(same, F.lit(False))), rows.where(~F.coalesce(same, F.lit(False)))


def read_pbp_seasons(spark: SparkSession, paths: list[str], columns: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """(rows of season files with the required columns only, files that do not hold one season each)."""
    rows = spark.read.schema(", ".join(f"{c} {t}" for c, t in columns.items())).parquet(*paths).withColumn("_file", F.input_file_name())
    per_file = rows.groupBy("_file").agg(F.count_distinct("season").alias("seasons"), F.count_if(F.col("season").isNull()).alias("unknown"))
    return rows.drop("_file"), per_file.where("seasons <> 1 OR unknown > 0")


def read_match_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(matches of a JSON array, match ids that occur more than once)."""
    rows = spark.read.schema(MATCH).option("multiLine", True).json(path)
    return rows, rows.groupBy("match_id").count().where("count > 1")


def read_match_events(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(events with the match id of their file's name, events whose index does not rise by one or whose id repeats)."""
    rows = spark.read.schema(EVENT).option("multiLine", True).json(path).withColumn("match_id", F.regexp_extract(F.input_file_name(), r"/(\d+)\.json", 1).try_cast("long"))
    nth = F.row_number().over(Window.partitionBy("match_id").orderBy("index"))
    again = F.count(F.lit(1)).over(Window.partitionBy("match_id", "id"))
    judged = rows.withColumn("reasons", reasons({"index": F.col("index") != nth, "id": again > 1}))
    return rows, judged.where(F.size("reasons") > 0)


def read_rows_csv(spark: SparkSession, path: str, schema: str, key: str, index: str) -> tuple[DataFrame, DataFrame]:
    """(rows of a CSV whose header must be the schema's, keys whose index is not 1..n)."""
    rows = spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)
    each = rows.groupBy(key).agg(F.min(index).alias("low"), F.max(index).alias("high"), F.count_distinct(index).alias("n"), F.count(F.lit(1)).alias("rows"))
    return rows, each.where("low <> 1 OR high <> n OR n <> rows")


def flatten_race_results(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """(season, round, item as JSON) of RaceTable.Races[].kind[], for Results, Laps or PitStops."""
    item = "map<string,string>"
    schema = f"MRData struct<RaceTable:struct<Races:array<struct<season:string,round:string,{kind}:array<{item}>>>>>"
    races = spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("MRData.RaceTable.Races").alias("r"))
    return races.select("r.season", F.col("r.round").cast("int").alias("round"), F.explode(f"r.{kind}").alias("item"))


def read_pairs_csv(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(candidate pairs with decimal confidence, bad rows): trimmed cells, a plain decimal, an unordered pair only once."""
    raw = spark.read.schema(PAIR).option("header", True).option("enforceSchema", False).csv(path)
    pair = Window.partitionBy(F.least("left_market_id", "right_market_id"), F.greatest("left_market_id", "right_market_id"))
    untrimmed = F.lit(False)
    for c in raw.columns:
        untrimmed = untrimmed | (F.col(c) != F.trim(c))
    judged = raw.withColumn("reasons", reasons({"white space": untrimmed, "confidence": ~F.col("confidence").rlike(r"^(0(\.\d+)?|1(\.0+)?)$"), "repeated pair": F.count(F.lit(1)).over(pair) > 1}))
    good = judged.where(F.size("reasons") == 0).drop("reasons").withColumn("confidence", F.col("confidence").cast("decimal(18,9)"))
    return good, judged.where(F.size("reasons") > 0)
