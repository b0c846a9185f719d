"""Native records as typed fields, and the names of what is wrong with them."""

import datetime

from pyspark.sql import functions as F

from feedlab.functions import adapters

TEAMS = {"Owls": ("Night Owls", "OWL"), "Foxes": ("Red Foxes", "FOX")}


def test_market_texts_must_agree(spark):
    good = {"question": "NFL Sunday: Owls vs. Foxes", "slug": "nfl-sunday-owls-vs-foxes", "outcomes": '["Owls", "Foxes"]', "token_ids": '["11", "12"]', "description": 'In the upcoming NFL game scheduled for January 5, 2025:\n\nIf the Night Owls win, this market will resolve to "Owls".\nIf the Red Foxes win, this market will resolve to "Foxes".'}
    twice = good["description"] + '\nIf the Red Foxes win, this market will resolve to "Foxes".'
    cases = [({}, []), ({"question": "NFL Sunday: Foxes vs. Owls"}, ["question"]), ({"slug": "nfl-monday-owls-vs-foxes"}, ["slug"]), ({"description": twice}, ["clause"]), ({"description": good["description"].replace("January 5", "January 45")}, ["date"]), ({"token_ids": '["11", "11"]'}, ["tokens"]), ({"outcomes": '["Owls", "Hens"]'}, ["alias", "question", "slug", "clause"]), ({"outcomes": None}, ["outcomes", "alias", "question", "slug", "clause"])]
    df = spark.createDataFrame([(i, *[{**good, **c}[k] for k in good]) for i, (c, _) in enumerate(cases)], "i int, " + ", ".join(f"{k} string" for k in good))
    got = {r.i: r for r in adapters.market_identity(df, TEAMS).collect()}
    assert {i: r.reasons for i, r in got.items()} == {i: want for i, (_, want) in enumerate(cases)}
    assert (got[0].clubs, got[0].tokens, got[0].game_date) == (["OWL", "FOX"], ["11", "12"], datetime.date(2025, 1, 5)) and got[1].clubs is None


def test_action_details(spark):
    rows = [
        ("Pass", '{"pass": {"end_location": [60.25, 40.5], "outcome": {"name": "Out"}}}', (60_250, 40_500, "Out", None, None, None, None, None, [])),
        ("Pass", '{"pass": {"end_location": [120.5, 1]}}', (120_500, 1_000, None, None, None, None, None, None, ["end_location"])),
        ("Carry", '{"carry": {"end_location": [1.0001, 2]}}', (None, 2_000, None, None, None, None, None, None, ["end_location"])),
        ("Carry", "{}", (None, None, None, None, None, None, None, None, ["detail"])),
        ("Shot", '{"shot": {"end_location": [119, 38.1, 2.7], "outcome": {"name": "Goal"}, "type": {"name": "Penalty"}}}', (119_000, 38_100, None, "Goal", "Penalty", None, None, 7, [])),
        ("Shot", '{"shot": {"outcome": {"name": "Saved"}}}', (None, None, None, "Saved", None, None, None, None, ["shot_type"])),
        ("Substitution", '{"substitution": {"replacement": {"id": 33}}}', (None, None, None, None, None, None, 33, None, [])),
        ("Substitution", "{}", (None, None, None, None, None, None, None, None, ["replacement"])),
        ("Own Goal For", "{}", (None, None, None, None, None, None, None, 7, [])),
        ("Foul Committed", '{"foul_committed": {"card": {"name": "Red Card"}}}', (None, None, None, None, None, "Red Card", None, None, [])),
        ("Bad Behaviour", '{"bad_behaviour": {"card": {"name": "Green Card"}}}', (None, None, None, None, None, "Green Card", None, None, ["card"])),
        ("Foul Committed", "{}", (None,) * 8 + ([],)),
    ]
    df = spark.createDataFrame([(i, a, e) for i, (a, e, _) in enumerate(rows)], "i int, action string, event string")
    got = {r.i: tuple(r.d) for r in df.select("i", adapters.action_details(F.col("event"), F.col("action"), F.lit(7)).alias("d")).collect()}
    assert got == {i: want for i, (_, _, want) in enumerate(rows)}
    free = df.where("i = 1").select(adapters.action_details(F.col("event"), F.col("action"), F.lit(7), bounded=False)["reasons"]).first()[0]
    assert free == []


def test_baseball_rows(spark):
    names = "inning int, batting_home int, outs_before int, runner_on_first string, runner_on_second string, runner_on_third string, away_score_before int, home_score_before int, batter_id string, pitcher_id string, balls_before int, strikes_before int, lineup_slot int, away_team string, home_team string"
    df = spark.createDataFrame([(3, 1, 2, "r1", "", None, 4, 0, "b", "p", 3, 2, 9, "A", "H"), (0, 2, 3, None, None, None, -1, 0, "", None, 4, 3, 10, "A", "H")], names)
    good, bad = sorted(adapters.baseball_snapshot(df).collect(), key=lambda r: len(r.reasons))
    s = good.snapshot
    assert (s.half, s.bases, s.batting_team, s.fielding_team, s.outs) == ("bottom", ["r1", None, None], "H", "A", 2) and good.reasons == []
    assert bad.reasons == ["inning", "batting_home", "outs", "score", "batter", "pitcher", "balls", "strikes", "lineup_slot"] and bad.snapshot is None
    plays = [
        (["r1", None, "r3"], [1, 2, None, 4], 0, [("b", 0, 1), ("r1", 1, 2), ("r3", 3, 4)], 1, []),
        (["r1", None, None], [0, 0, None, None], 2, [("b", 0, 0), ("r1", 1, 0)], 0, []),
        (["r1", "r2", None], [1, None, None, None], 0, [("b", 0, 1)], 0, ["base_taken"]),
        ([None, "r2", None], [1, 3, 1, None], 0, [("b", 0, 1), ("r2", 2, 1)], 0, ["no_runner", "base_taken", "moved_back"]),
        ([None, None, None], [5, None, None, None], 1, [("b", 0, 4)], 1, ["outs"]),
    ]
    df = spark.createDataFrame([(i, *p[:3]) for i, p in enumerate(plays)], "i int, bases array<string>, to array<int>, outs int")
    got = {r.i: r.m for r in df.select("i", adapters.runner_advances(F.lit("b"), F.col("bases"), F.col("to"), F.col("outs")).alias("m")).collect()}
    for i, (*_, moves, runs, reasons) in enumerate(plays):
        assert ([tuple(m) for m in got[i].moves], got[i].runs, got[i].reasons) == (moves, runs, reasons), i


def test_advances_are_compiled(spark):
    df = spark.createDataFrame([(None, [1, None, None, None], 0), (["r1", None, None], None, None), ([None, None, "r3"], [None, None, None, 6], 0)], "bases array<string>, to array<int>, outs int")
    out = df.select(adapters.runner_advances(F.lit("b"), F.col("bases"), F.col("to"), F.col("outs")).alias("m")).select("m.moves", "m.runs", "m.outs")
    assert out._jdf.queryExecution().optimizedPlan().toString().count("lambdafunction(") <= 1  # they are interpreted; one leaves out what is no reason
    assert [(r.moves and [tuple(m) for m in r.moves], r.runs, r.outs) for r in out.collect()] == [(None, None, None), ([], 0, 0), ([("r3", 3, 4)], 1, 0)]


def test_action_texts_are_parsed_once(spark):
    df = spark.createDataFrame([("Shot", '{"shot": {"end_location": [1, 2], "outcome": {"name": "Goal"}, "type": {"name": "Penalty"}}}'), (None, '{"shot": {"outcome": {"name": "Saved"}}}')], "action string, event string")
    out = df.select(adapters.action_details(F.col("event"), F.col("action"), F.lit(7)).alias("d")).select("d.end_x", "d.shot_outcome", "d.scores", "d.reasons")
    assert out._jdf.queryExecution().optimizedPlan().toString().count("from_json(") == 1
    assert [tuple(r) for r in out.collect()] == [(1000, "Goal", 7, []), (None, None, None, ["shot_type", "replacement"])]
