"""Point-in-time joins. All are linear: both sides are put on one timeline per key, which running windows read part by part."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Length of the parts that a key's timeline is cut into: microseconds for timestamps, else units of the column.
PART_US = 86_400_000_000


def _part(df: DataFrame, column: str, width: int) -> Column:
    kind = df.schema[column].dataType.typeName()
    number = F.unix_micros(F.col(column).cast("timestamp")) if kind in ("timestamp", "timestamp_ntz", "date") else F.col(column)
    return F.floor(number / width).cast("long")


def _timeline(points: DataFrame, rows: DataFrame, keys: list[str], at: str, time: str, take: list[str], tie: str | None, point_tie: str | None, width: int) -> DataFrame:
    tie_of = lambda df, c: F.col(c) if c else F.lit(None)
    point_cols = [c for c in points.columns if c not in keys]
    left = points.select(*keys, _part(points, at, width).alias("_part"), F.col(at).alias("_t"), tie_of(points, point_tie).alias("_tie"), F.lit(1).alias("_side"), F.struct(*point_cols).alias("_point"))
    right = rows.select(*keys, _part(rows, time, width).alias("_part"), F.col(time).alias("_t"), tie_of(rows, tie).alias("_tie"), F.lit(0).alias("_side"), F.struct(*take).alias("_row"))
    return left.unionByName(right, allowMissingColumns=True)


def _flat(df: DataFrame, keys: list[str], points: DataFrame, take: list[str], found: Column) -> DataFrame:
    got = df.withColumn("_found", F.when(F.col("_t").isNotNull(), found)).where("_side = 1")
    return got.select(*keys, *[F.col(f"_point.{c}").alias(c) for c in points.columns if c not in keys], *[F.col(f"_found.{c}").alias(c) for c in take])


def _nearest(both: DataFrame, keys: list[str], ahead: bool, among: list[Column]) -> tuple[DataFrame, Column]:
    """The timeline with, at the head of each part, the row that the parts before it leave, and the window that reads it.

    ``among``: the order of rows and points of equal time. A part's last row is an aggregate that Spark starts before the shuffle; only the parts' rows run through a window by key.
    """
    end = F.max_by if not ahead else F.min_by
    # nulls of the tie are smallest in both directions
    place = F.struct(F.col("_t"), F.col("_tie").isNotNull(), F.col("_tie"))
    ends = both.where("_part IS NOT NULL").groupBy(*keys, "_part").agg(end("_row", F.when(F.col("_side") == 0, place)).alias("_row"), F.max("_side").alias("_asked"))
    w = Window.partitionBy(*keys).orderBy(F.col("_part").desc() if ahead else F.col("_part").asc()).rowsBetween(Window.unboundedPreceding, -1)
    heads = ends.withColumn("_row", F.last("_row", ignorenulls=True).over(w)).where("_asked = 1 AND _row IS NOT NULL").select(*keys, "_part", "_row", F.lit(0).alias("_head"))
    line = both.withColumn("_head", F.lit(1)).unionByName(heads, allowMissingColumns=True)
    time = F.col("_t").desc() if ahead else F.col("_t").asc()
    return line, F.last("_row", ignorenulls=True).over(Window.partitionBy(*keys, "_part").orderBy("_head", time, *among).rowsBetween(Window.unboundedPreceding, 0))


def first_at_or_after(points: DataFrame, rows: DataFrame, keys: list[str], at: str, time: str, take: list[str], tie: str | None = None, point_tie: str | None = None, strict: bool = False, part: int = PART_US) -> DataFrame:
    """Each point with ``take`` of the first row at or after it (strictly after it with ``strict``), null if there is none.

    A point without a time has no row. Rows of equal time come in the order of ``tie``; with ``point_tie`` a point has a place among them.
    A key's timeline is cut into parts of the length ``part``, so that no task holds all rows of a key.
    """
    both = _timeline(points, rows, keys, at, time, take, tie, point_tie, part)
    side, tie_order = F.col("_side").desc() if strict else F.col("_side").asc(), F.col("_tie").desc_nulls_last()
    line, found = _nearest(both, keys, True, [tie_order, side] if point_tie else [side, tie_order])
    return _flat(line, keys, points, take, found)


def last_at_or_before(points: DataFrame, rows: DataFrame, keys: list[str], at: str, time: str, take: list[str], tie: str | None = None, part: int = PART_US) -> DataFrame:
    """Each point with ``take`` of the last row at or before it, null if there is none; cut into parts as ``first_at_or_after``."""
    both = _timeline(points, rows, keys, at, time, take, tie, None, part)
    line, found = _nearest(both, keys, False, [F.col("_side").asc(), F.col("_tie").asc_nulls_first()])
    return _flat(line, keys, points, take, found)


def asof_rule(points: DataFrame, rules: DataFrame, keys: list[str], at: str, max_age_us: int, fetched: str = "fetched", effective: str = "effective", valid: str = "valid", ident: str = "rule_id", take: list[str] | None = None, part: int = PART_US) -> DataFrame:
    """Each point with ``status`` and, where it is ok, the rule in force: fetched and effective by then, latest of both.

    ``missing``: nothing was fetched. ``not_effective``/``invalid``: nothing valid is effective (and something was invalid).
    ``invalid``: an invalid observation is as late as the chosen rule. ``stale``: the rule is older than ``max_age_us``.
    The pick is by effective time, not by arrival, so running maxima over the timeline are kept, not the last row; those of
    a part begin with the maxima of the parts before it.
    """
    take = take or [ident]
    point_cols = [c for c in points.columns if c not in keys]
    pick = F.struct(F.col(effective).alias("e"), F.col(fetched).alias("f"), F.col(ident).alias("i"), *[F.col(c).alias(f"_{c}") for c in take])
    probes = points.select(*keys, F.col(at).alias("_t"), F.lit(1).alias("_side"), F.struct(*point_cols).alias("_point"))
    seen = rules.select(*keys, F.col(fetched).alias("_t"), F.lit(0).alias("_side"), F.lit(True).alias("_seen"), F.when(~F.col(valid), F.col(fetched)).alias("_invalid"))
    usable = rules.where(F.col(valid)).select(*keys, F.greatest(fetched, effective).alias("_t"), F.lit(0).alias("_side"), pick.alias("_pick"))
    line = probes.unionByName(seen, True).unionByName(usable, True)
    line = line.withColumn("_part", _part(line, "_t", part))
    running = ("_seen", "_pick", "_invalid")
    parts = line.where("_part IS NOT NULL").groupBy(*keys, "_part").agg(*[F.max(c).alias(c) for c in running], F.max("_side").alias("_asked"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    heads = parts.withColumns({c: F.max(c).over(before) for c in running}).where("_asked = 1").select(*keys, "_part", *running, F.lit(0).alias("_side"), F.lit(0).alias("_head"))
    line = line.withColumn("_head", F.lit(1)).unionByName(heads, allowMissingColumns=True)
    w = Window.partitionBy(*keys, "_part").orderBy("_head", "_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    got = line.withColumns({"_s": F.max("_seen").over(w), "_c": F.max("_pick").over(w), "_i": F.max("_invalid").over(w)}).where("_side = 1")
    age = F.unix_micros("_t") - F.unix_micros("_c.f")
    status = (
        F.when(F.col("_s").isNull(), "missing").when(F.col("_c").isNull() & F.col("_i").isNotNull(), "invalid").when(F.col("_c").isNull(), "not_effective")
        .when(F.col("_i") >= F.col("_c.f"), "invalid").when(age > max_age_us, "stale").otherwise("ok")
    )
    ok = status == "ok"
    return got.select(*keys, *[F.col(f"_point.{c}").alias(c) for c in point_cols], status.alias("status"), *[F.when(ok, F.col(f"_c._{c}")).alias(c) for c in take])


def prefix_counts(points: DataFrame, events: DataFrame, keys: list[str], order: list[str], kinds: dict[str, Column]) -> DataFrame:
    """Each point with, for each kind, the events of its key at or before it in the order of the columns ``order``."""
    rest = [c for c in points.columns if c not in keys and c not in order]
    left = points.select(*keys, *order, F.lit(1).alias("_side"), F.struct(*rest).alias("_point"))
    right = events.select(*keys, *order, F.lit(0).alias("_side"), *[c.cast("int").alias(f"_n_{k}") for k, c in kinds.items()])
    w = Window.partitionBy(*keys).orderBy(*order, "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = left.unionByName(right, True).withColumns({k: F.coalesce(F.sum(f"_n_{k}").over(w), F.lit(0)) for k in kinds}).where("_side = 1")
    return both.select(*keys, *order, *[F.col(f"_point.{c}").alias(c) for c in rest], *kinds)


def first_in_window(points: DataFrame, events: DataFrame, keys: list[str], at: str, time: str, horizon_us: int, take: list[str], tie: str, none: str = "none") -> DataFrame:
    """Each point with ``take`` of the first event in (at, at + horizon]; the first taken column says ``none`` if there is none."""
    got = first_at_or_after(points, events.withColumn("_time", F.col(time)), keys, at, time, [*take, "_time"], tie=tie, strict=True)
    inside = F.unix_micros("_time") - F.unix_micros(at) <= horizon_us
    out = got.withColumns({c: F.when(inside, F.col(c)) for c in take}).drop("_time")
    return out.withColumn(take[0], F.coalesce(take[0], F.lit(none)))


def range_join(points: DataFrame, rows: DataFrame, keys: list[str], start: str, end: str, time: str, width_us: int) -> DataFrame:
    """Pairs of a point and the rows of its key with start <= time <= end, by equal buckets of ``width_us`` and an exact check."""
    bucket = lambda c: F.floor(F.unix_micros(c) / width_us)
    left = points.withColumn("_b", F.explode(F.sequence(bucket(start), bucket(end))))
    right = rows.withColumn("_b", bucket(time))
    return left.join(right, [*keys, "_b"]).where((F.col(time) >= F.col(start)) & (F.col(time) <= F.col(end))).drop("_b")


#: Rows of a grid at most; it is broadcast and multiplies every row.
MOST_GRID_ROWS = 10_000


def cross_grid(df: DataFrame, grid: DataFrame) -> DataFrame:
    """Every row with every row of a grid; ValueError for a grid of more than MOST_GRID_ROWS rows."""
    if grid.limit(MOST_GRID_ROWS + 1).count() > MOST_GRID_ROWS:
        raise ValueError(f"a grid has at most {MOST_GRID_ROWS} rows")
    return df.crossJoin(F.broadcast(grid))


def align_four(models: DataFrame, quotes: DataFrame, rules: DataFrame, metadata: DataFrame, keys: list[str], cutoff: str, max_age_us: int) -> DataFrame:
    """Model rows with the quote, rule and metadata known by their cutoff, and why any of them is not usable.

    A quote must be known, active and no older than ``max_age_us`` at the cutoff; a rule in force; metadata captured by then.
    """
    q = last_at_or_before(models, quotes, keys, cutoff, "received", ["quote_id", "state", "received"], tie="quote_id").withColumnRenamed("received", "quote_at")
    r = asof_rule(q, rules, keys, cutoff, 1 << 62).withColumnRenamed("status", "rule_status")
    m = last_at_or_before(r, metadata, keys, cutoff, "captured", ["meta_id"], tie="meta_id")
    old = F.unix_micros(cutoff) - F.unix_micros("quote_at") > max_age_us
    why = F.array_compact(F.array(
        F.when(F.col("quote_id").isNull(), "no quote").when(F.col("state") == "SUSPENDED", "suspended").when(old, "stale quote"),
        F.when(F.col("rule_status") != "ok", F.concat(F.lit("rule "), F.col("rule_status"))),
        F.when(F.col("meta_id").isNull(), "no metadata"),
    ))
    return m.withColumn("reasons", why)
