"""Parsing, normalising and hashing of text columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Identifier patterns and closed vocabularies of the data model.
ID_PATTERNS = {
    "sha256": r"^sha256:[0-9a-f]{64}$",
    "event": r"^evt_[0-9a-f]{64}$",
    "venue": r"^[a-z0-9][a-z0-9._-]*$",
    "competition": r"^cmp_[A-Za-z0-9][A-Za-z0-9._:-]*$",
    "game": r"^game_[A-Za-z0-9][A-Za-z0-9._:-]*$",
    "participant": r"^participant_[A-Za-z0-9][A-Za-z0-9._:-]*$",
    "venue_event": r"^venue_event_[A-Za-z0-9][A-Za-z0-9._:-]*$",
    "market": r"^market_[A-Za-z0-9][A-Za-z0-9._:-]*$",
    "outcome": r"^outcome_[A-Za-z0-9][A-Za-z0-9._:-]*$",
    "condition": r"^condition_[A-Za-z0-9][A-Za-z0-9._:-]*$",
    "experiment": r"^X-[0-9]{2,}$",
}
# Native drive results and their class; everything else is "other".
DRIVE_CLASSES = {"touchdown": "touchdown", "field goal": "field_goal", "punt": "punt", "turnover": "turnover", "turnover on downs": "turnover"}

UTC_TEXT = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d{1,6})?Z$"
DECIMAL_TEXT = r"^-?\d+(\.\d+)?$"


def is_id(c: Column, kind: str) -> Column:
    """Whether a value is a well-formed identifier of a kind; null is not."""
    return F.coalesce(c.rlike(ID_PATTERNS[kind]), F.lit(False))


def folded(c: Column) -> Column:
    """Trimmed, lower-cased, runs of white space as one blank."""
    return F.lower(F.regexp_replace(F.trim(c), r"\s+", " "))


def label_map(c: Column, classes: dict[str, str] = DRIVE_CLASSES, other: str = "other") -> Column:
    """Class of a native label; unknown and null labels are ``other``."""
    table = F.create_map(*[F.lit(x) for pair in classes.items() for x in pair])
    return F.coalesce(F.element_at(table, folded(c)), F.lit(other))


def canonical_json(fields: dict[str, Column]) -> Column:
    """JSON object with sorted keys, no blanks and nulls kept; values are strings already in their canonical spelling."""
    return F.to_json(F.struct(*[fields[k].cast("string").alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"})


def canonical_hash(fields: dict[str, Column], prefix: str = "sha256:") -> Column:
    return F.concat(F.lit(prefix), F.sha2(canonical_json(fields), 256))


def parse_levels(c: Column, price: str = "decimal(9,4)", size: str = "decimal(18,6)") -> Column:
    """JSON ``[["price","size"],..]`` as an array of structs; null for bad JSON, null fields for bad numbers."""
    return F.transform(F.from_json(c, "array<array<string>>"), lambda x: F.struct(F.get(x, 0).try_cast(price).alias("price"), F.get(x, 1).try_cast(size).alias("size")))


def fixed_point_encode(c: Column) -> Column:
    """Decimal text as struct(atoms, scale): no exponent, at most 18 places, trailing zeros dropped, zero as 0 at scale 0; else null."""
    frac = F.regexp_replace(F.regexp_extract(c, r"^-?\d+(?:\.(\d+))?$", 1), "0+$", "")
    whole = F.regexp_extract(c, r"^(-?)0*(\d+)(?:\.\d+)?$", 1), F.regexp_extract(c, r"^-?0*(\d+)(?:\.\d+)?$", 1)
    digits = F.regexp_replace(F.concat(whole[1], frac), "^0+(?=.)", "")
    sign = F.when(digits == "0", "").otherwise(whole[0])
    ok = c.rlike(DECIMAL_TEXT) & (F.length(frac) <= 18)
    return F.when(ok, F.struct(F.concat(sign, digits).alias("atoms"), F.length(frac).alias("scale")))


def fixed_point_decode(atoms: Column, scale: Column) -> Column:
    """decimal(38,18) of atoms and scale."""
    sign = F.when(atoms.startswith("-"), "-").otherwise("")
    padded = F.lpad(F.regexp_replace(atoms, "-", ""), 40, "0")
    text = F.concat(sign, F.substr(padded, F.lit(1), 40 - scale), F.lit("."), F.substr(padded, 41 - scale, scale), F.lit("0"))
    return text.try_cast("decimal(38,18)")


def parse_utc(c: Column) -> Column:
    """Instant of strict UTC text (Z, up to six places); null for any other text."""
    return F.when(c.rlike(UTC_TEXT), F.try_to_timestamp(c))


def format_utc(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def flatten_frames(df: DataFrame, payload: str, keep: list[str], schema: str, kind: str) -> tuple[DataFrame, DataFrame]:
    """(events of frames that hold an object or an array of objects, frames that are neither); PONG frames are skipped."""
    frames = df.where(F.col(payload).isNull() | (F.col(payload) != "PONG"))
    text = F.when(F.substring(F.ltrim(F.col(payload)), 1, 1) == "[", F.col(payload)).otherwise(F.concat(F.lit("["), F.col(payload), F.lit("]")))
    parsed = frames.withColumn("_e", F.from_json(text, f"array<{schema}>", {"mode": "PERMISSIVE"}))
    bad = F.col("_e").isNull() | (F.size("_e") == 0) | F.exists(F.coalesce("_e", F.array().cast(f"array<{schema}>")), lambda x: x[kind].isNull())
    return parsed.where(~bad).select(*keep, F.inline("_e")), parsed.where(bad).select(*keep)


def clock_ms(c: Column) -> Column:
    """Milliseconds of HH:MM:SS.mmm."""
    part = lambda i: F.regexp_extract(c, r"^(\d{2}):(\d{2}):(\d{2})\.(\d{3})$", i).try_cast("long")
    return ((part(1) * 60 + part(2)) * 60 + part(3)) * 1000 + part(4)


def quarter_seconds(c: Column) -> Column:
    """Seconds of MM:SS; null for other text."""
    part = lambda i: F.regexp_extract(c, r"^(\d{1,2}):([0-5]\d)$", i).try_cast("int")
    return part(1) * 60 + part(2)


def overtime_seconds(season: Column, season_type: Column) -> Column:
    """Length of an overtime period: 900 s in the postseason and until 2016, 600 s since."""
    return F.when((season_type == "POST") | (season <= 2016), 900).otherwise(600)


def timeout_allotment(season_type: Column, period: Column) -> Column:
    """Timeouts of a team in the half that a period belongs to: 3, in regular-season overtime 2."""
    return F.when((period >= 5) & (season_type == "REG"), 2).otherwise(3)


def timeout_reset(season_type: Column, before: Column, after: Column) -> Column:
    """Timeouts that a period change resets to, null where it resets nothing."""
    overtime = F.when((season_type == "REG") & (after == 5), 2).when((season_type == "POST") & (after >= 5) & (after % 2 == 1), 3)
    return F.when((before == 2) & (after == 3), 3).otherwise(overtime)


def lifecycle_action(play_type: Column, text: Column) -> Column:
    """suspend, resume or none, of a comment row's text."""
    comment = play_type == "COMMENT"
    return F.when(comment & text.startswith("The game has been suspended."), "suspend").when(comment & text.startswith("The game has resumed."), "resume").otherwise("none")


def timeout_kind(native: Column, play_type: Column, observed: Column) -> Column:
    """none, administrative (a timeout row of its own) or play_attached."""
    own = F.coalesce((native == "TIMEOUT") & (play_type == "no_play"), F.lit(False))
    return F.when(~F.coalesce(observed, F.lit(False)), "none").when(own, "administrative").otherwise("play_attached")


def event_id(df: DataFrame, columns: list[str], prefix: str = "evt_") -> Column:
    """Prefix and hash of the whole row but for its id."""
    return canonical_hash({c: F.col(c) for c in columns}, prefix)


def rule_errors(doc: Column, required: dict[str, str]) -> Column:
    """Sorted error codes of a JSON rule: MISSING_RULE_FIELD:name, INVALID_RULE_FIELD:name (text does not match its pattern)."""
    value = lambda name: F.get_json_object(doc, f"$.{name}")
    codes = [F.when(value(n).isNull(), F.lit(f"MISSING_RULE_FIELD:{n}")).when(~value(n).rlike(p), F.lit(f"INVALID_RULE_FIELD:{n}")) for n, p in required.items()]
    return F.array_sort(F.array_compact(F.array(*codes)))


#: Minutes on the match clock at which each period begins.
PERIOD_MINUTES = {1: 0, 2: 45, 3: 90, 4: 105, 5: 120}


def soccer_clock(period: Column, timestamp: Column, minute: Column, second: Column) -> dict[str, Column]:
    """period_ms (time in the period), match_ms, and clock_ok: whether minute and second are those of the timestamp; null for unknown periods and texts."""
    ms = clock_ms(timestamp)
    start = F.try_element_at(F.create_map(*[F.lit(x) for pair in PERIOD_MINUTES.items() for x in pair]), period)
    match = ms + start.cast("long") * 60_000
    return {"period_ms": ms, "match_ms": match, "clock_ok": (F.floor(match / 60_000) == minute) & (F.floor(ms / 1000) % 60 == second)}


def envelope(df: DataFrame, columns: list[str], payload: str, source: Column, occurred: Column) -> dict[str, Column]:
    """An event's envelope: id of its columns, hash of the payload alone, source, time, and the hash of the four."""
    ident, body, us = event_id(df, columns), F.sha2(F.col(payload).cast("binary"), 256), F.unix_micros(occurred)
    return {"event": ident, "payload_sha256": body, "source": source, "occurred_us": us, "envelope_sha256": F.sha2(F.concat_ws("|", ident, body, source, us.cast("string")), 256)}
