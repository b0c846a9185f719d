"""Typed fields out of native records: market texts, match actions, baseball rows. Columns only; what is wrong is named, never guessed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The wording of the markets.
QUESTION = r"^NFL (Sunday|Monday): ([A-Za-z]+) vs\. ([A-Za-z]+)$"
DESCRIPTION = r"^In the upcoming NFL game scheduled for ([A-Z][a-z]+ [0-9]{1,2}, [0-9]{4}):\n\n"
CLAUSE = ('If the ', ' win, this market will resolve to "', '".')
CARDS = ("Yellow Card", "Second Yellow", "Red Card")  # fixed values
PITCH_MILLI = (120_000, 80_000)  # fixed values: length and width of the pitch


def _named(**checks: Column) -> Column:
    """Names of the checks that don't hold; one that is null does not."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()]))


def market_identity(df: DataFrame, teams: dict[str, tuple[str, str]]) -> DataFrame:
    """``df`` with ``aliases``, ``tokens``, ``clubs`` (abbreviations), ``game_date`` and ``reasons``, from texts that must agree.

    Reads question, slug, description, outcomes and token_ids (the last two JSON lists of two different texts). ``teams``
    maps each alias to its full name and abbreviation; it is code, so of fixed size. The parsed fields are null unless
    ``reasons`` is empty.
    """
    two = lambda c: F.from_json(c, "array<string>")
    pair = lambda c: (F.size(c) == 2) & (F.get(c, 0) != F.get(c, 1)) & (F.get(c, 0) != "") & (F.get(c, 1) != "")
    known = F.create_map(*[F.lit(x) for k, v in teams.items() for x in (k, v[0])])
    short = F.create_map(*[F.lit(x) for k, v in teams.items() for x in (k, v[1])])
    got = df.withColumns({"_o": two(F.col("outcomes")), "_t": two(F.col("token_ids"))})
    part = lambda i: F.regexp_extract("question", QUESTION, i)
    first, second = F.get("_o", 0), F.get("_o", 1)
    date = F.try_to_timestamp(F.regexp_extract("description", DESCRIPTION, 1), F.lit("MMMM d, yyyy")).cast("date")
    slug = F.concat(F.lit("nfl-"), F.lower(part(1)), F.lit("-"), F.lower(first), F.lit("-vs-"), F.lower(second))

    def once(alias: Column) -> Column:
        clause = F.concat(F.lit(CLAUSE[0]), known[alias], F.lit(CLAUSE[1]), alias, F.lit(CLAUSE[2]))
        return F.char_length("description") - F.char_length(F.replace(F.col("description"), clause, F.lit(""))) == F.char_length(clause)

    reasons = _named(
        outcomes=pair(F.col("_o")), tokens=pair(F.col("_t")), alias=known[first].isNotNull() & known[second].isNotNull(),
        question=(part(2) == first) & (part(3) == second), slug=F.col("slug") == slug, date=date.isNotNull(), clause=once(first) & once(second),
    )
    ok = F.size("reasons") == 0
    out = got.withColumn("reasons", reasons)
    return out.withColumns({"aliases": F.when(ok, F.col("_o")), "tokens": F.when(ok, F.col("_t")), "clubs": F.when(ok, F.transform("_o", lambda a: short[a])), "game_date": F.when(ok, date)}).drop("_o", "_t")


ACTION = (
    "struct<pass:struct<end_location:array<string>,outcome:struct<name:string>>,carry:struct<end_location:array<string>>,goalkeeper:struct<end_location:array<string>>,"
    "shot:struct<end_location:array<string>,outcome:struct<name:string>,type:struct<name:string>>,substitution:struct<replacement:struct<id:bigint>>,"
    "bad_behaviour:struct<card:struct<name:string>>,foul_committed:struct<card:struct<name:string>>>"
)


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once a row: fields of a parsed text would each parse it again."""
    return F.get(F.transform(F.array(value), body), 0)


def _milli(location: Column, place: int) -> Column:
    """A coordinate in whole thousandths; null where it has more than three decimals or is no number."""
    scaled = F.get(location, place).try_cast("decimal(20,9)") * 1000
    return F.when(scaled == F.floor(scaled), scaled.cast("long"))


def action_details(event: Column, action: Column, team: Column, bounded: bool = True) -> Column:
    """struct(end_x, end_y, pass_outcome, shot_outcome, shot_type, card, replacement, scores, reasons) of one match event.

    ``event`` is its JSON text. Coordinates are thousandths, within the pitch if ``bounded``; ``scores`` is the team that
    the action scores for. ``reasons`` names what the action lacks or has wrong.
    """

    def fields(e: Column) -> Column:
        shot = e["shot"]
        return F.struct(
            e.isNotNull().alias("json"), F.when(action == "Pass", e["pass"].isNotNull()).when(action == "Carry", e["carry"].isNotNull()).when(action == "Goal Keeper", e["goalkeeper"].isNotNull()).when(action == "Shot", shot.isNotNull()).otherwise(F.lit(True)).alias("detail"),
            F.when(action == "Pass", e["pass"]["end_location"]).when(action == "Carry", e["carry"]["end_location"]).when(action == "Goal Keeper", e["goalkeeper"]["end_location"]).when(action == "Shot", shot["end_location"]).alias("at"),
            F.when(action == "Pass", e["pass"]["outcome"]["name"]).alias("pass_outcome"), shot["outcome"]["name"].alias("goal"), shot["type"]["name"].alias("type"),
            F.when(action == "Bad Behaviour", e["bad_behaviour"]["card"]["name"]).when(action == "Foul Committed", e["foul_committed"]["card"]["name"]).alias("card"), F.when(action == "Substitution", e["substitution"]["replacement"]["id"]).alias("replacement"),
        )

    def placed(f: Column) -> Column:
        return F.struct(f.alias("f"), _milli(f["at"], 0).alias("x"), _milli(f["at"], 1).alias("y"))

    def result(g: Column) -> Column:
        f, x, y, shot = g["f"], g["x"], g["y"], action == "Shot"
        inside = (x.between(0, PITCH_MILLI[0]) & y.between(0, PITCH_MILLI[1])) if bounded else (x.isNotNull() & y.isNotNull())
        reasons = _named(
            json=f["json"], detail=f["detail"], end_location=f["at"].isNull() | (F.size(f["at"]).isin(2, 3) & F.coalesce(inside, F.lit(False))),
            shot_outcome=~shot | f["goal"].isNotNull(), shot_type=~shot | f["type"].isNotNull(),
            card=f["card"].isNull() | f["card"].isin(*CARDS), replacement=(action != "Substitution") | (f["replacement"] >= 1),
        )
        return F.struct(
            x.alias("end_x"), y.alias("end_y"), f["pass_outcome"].alias("pass_outcome"), F.when(shot, f["goal"]).alias("shot_outcome"), F.when(shot, f["type"]).alias("shot_type"),
            f["card"].alias("card"), f["replacement"].alias("replacement"), F.when((shot & (f["goal"] == "Goal")) | (action == "Own Goal For"), team).alias("scores"), reasons.alias("reasons"),
        )

    return _let(_let(_let(F.from_json(event, ACTION), fields), placed), result)


def baseball_snapshot(df: DataFrame, away: str = "away_team", home: str = "home_team") -> DataFrame:
    """``df`` with ``snapshot``: the state before a play from its row, and ``reasons`` for values that no state can have.

    Reads inning, batting_home, outs_before, runner_on_first, _second and _third, away_score_before, home_score_before,
    batter_id, pitcher_id, balls_before, strikes_before and lineup_slot.
    """
    bottom = F.col("batting_home") == 1
    reasons = _named(
        inning=F.col("inning") >= 1, batting_home=F.col("batting_home").isin(0, 1), outs=F.col("outs_before").between(0, 2), score=(F.col("away_score_before") >= 0) & (F.col("home_score_before") >= 0),
        batter=F.col("batter_id") != "", pitcher=F.col("pitcher_id") != "", balls=F.col("balls_before").between(0, 3), strikes=F.col("strikes_before").between(0, 2), lineup_slot=F.col("lineup_slot").between(1, 9),
    )
    runner = lambda c: F.when(F.col(c) != "", F.col(c))
    state = F.struct(
        F.col("inning"), F.when(bottom, "bottom").otherwise("top").alias("half"), F.col("outs_before").alias("outs"), F.array(*map(runner, ("runner_on_first", "runner_on_second", "runner_on_third"))).alias("bases"),
        F.col("away_score_before").alias("away_score"), F.col("home_score_before").alias("home_score"), F.when(bottom, F.col(home)).otherwise(F.col(away)).alias("batting_team"), F.when(bottom, F.col(away)).otherwise(F.col(home)).alias("fielding_team"),
        F.col("batter_id"), F.col("pitcher_id"), F.col("balls_before").alias("balls"), F.col("strikes_before").alias("strikes"), F.col("lineup_slot"),
    )
    return df.withColumns({"reasons": reasons, "snapshot": F.when(F.size(reasons) == 0, state)})


def runner_advances(batter: Column, bases: Column, destinations: Column, outs_on_play: Column) -> Column:
    """struct(moves, runs, outs, reasons): who moves from where to where in a play.

    ``bases`` has three places, ``destinations`` one for the batter and each base: 0 out, 1 to 3 a base, 4 and above home,
    null stays. A runner who stays makes no move; a destination without a runner, a base taken twice, a move back and
    other outs than ``outs_on_play`` are named. Plain columns, as functions of array elements are interpreted row by row.
    """
    runner = [batter, *[F.get(bases, i) for i in range(3)]]
    end = [F.when(F.get(destinations, i) > 4, 4).otherwise(F.get(destinations, i)).cast("int") for i in range(4)]
    yes = lambda c: F.coalesce(c, F.lit(False))
    there = [r.isNotNull() for r in runner]
    place = [F.when(there[i], F.coalesce(end[i], F.lit(i))) for i in range(4)]  # null: nobody
    moved = [yes(there[i] & (end[i].isNotNull() & (end[i] != i) | ((end[i] == 0) if i == 0 else F.lit(False)))) for i in range(4)]
    moves = [F.struct(runner[i].alias("runner"), F.lit(i).alias("start"), end[i].alias("end")) for i in range(4)]
    count = lambda where: sum((yes(there[i] & (end[i] == where)).cast("int") for i in range(4)), F.lit(0))
    any_of = lambda found: F.greatest(*map(yes, found))
    known, outs = bases.isNotNull(), count(0)
    reasons = _named(
        no_runner=known & ~any_of([~there[i] & (end[i] > 0) for i in range(4)]), base_taken=known & ~any_of([(place[i] == place[j]) & place[i].between(1, 3) for i in range(4) for j in range(i)]),
        moved_back=known & ~any_of([there[i] & (end[i] > 0) & (end[i] < i) for i in range(4)]), outs=known & (outs == outs_on_play),
    )
    listed = F.concat(*[F.when(m, F.array(x)).otherwise(F.slice(F.array(x), 1, 0)) for m, x in zip(moved, moves, strict=True)])
    return F.struct(F.when(known, listed).alias("moves"), F.when(known, count(4)).alias("runs"), F.when(known, outs).alias("outs"), reasons.alias("reasons"))
