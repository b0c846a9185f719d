"""Reducers for the keyed fold: one for each sport. Each takes (state, row) and raises RuleBroken with a category.

They are small per-row helpers; Spark deals the games out, sorts each game's rows and streams them through
(``operators.fold.checked_fold``), so a season is one job.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.fold import RuleBroken, checked_fold

# --- basketball: score, fouls, possession, timeouts and periods ---------------------------------------------------------


def nba_start() -> dict:
    return {"period": 1, "clock": None, "score": [0, 0], "fouls": [0, 0], "ball": None, "ended": False}


def nba_reduce(s: dict, r: dict) -> tuple[dict, dict]:
    """Row: kind, period, clock_ms, side (0 home, 1 away, null), points."""
    if s["ended"]:
        raise RuleBroken("after_terminal")
    kind, side = r["kind"], r["side"]
    s = {**s, "score": list(s["score"]), "fouls": list(s["fouls"])}
    if kind == "period":
        if r["period"] != s["period"] + 1:
            raise RuleBroken("period_step")
        s.update(period=r["period"], clock=r["clock_ms"], fouls=[0, 0])
    else:
        if r["period"] != s["period"]:
            raise RuleBroken("period_changed_by_other_kind")
        if s["clock"] is not None and r["clock_ms"] > s["clock"]:
            raise RuleBroken("clock_rose")
        s["clock"] = r["clock_ms"]
    if kind == "score":
        if r["points"] not in (1, 2, 3):
            raise RuleBroken("points")
        s["score"][side] += r["points"]
    elif kind == "foul":
        s["fouls"][side] += 1
    elif kind == "possession":
        s["ball"] = side
    elif kind == "terminal":
        if s["period"] < 4 or s["clock"] != 0 or s["score"][0] == s["score"][1]:
            raise RuleBroken("terminal_too_early")
        s["ended"] = True
    elif kind not in ("period", "timeout"):
        raise RuleBroken("unknown_kind")
    return s, {"home_score": s["score"][0], "away_score": s["score"][1], "home_fouls": s["fouls"][0], "away_fouls": s["fouls"][1]}


# --- American football: clock, score and timeouts -----------------------------------------------------------------------


def nfl_start() -> dict:
    return {"period": None, "clock": None, "score": [0, 0], "timeouts": [3, 3], "suspended": False}


def nfl_reduce(s: dict, r: dict) -> tuple[dict, dict]:
    """Row: period, clock_s, home_score, away_score, home_timeouts, away_timeouts, season, season_type, action, correction."""
    s = {**s}
    if s["suspended"] and r["action"] != "resume":
        raise RuleBroken("suspended")
    s["suspended"] = r["action"] == "suspend"
    full = 900 if r["period"] <= 4 or r["season_type"] == "POST" or r["season"] <= 2016 else 600
    new = s["period"] is not None and r["period"] != s["period"]
    if s["period"] is not None and r["period"] not in (s["period"], s["period"] + 1):
        raise RuleBroken("period_step")
    clock = r["clock_s"] if r["clock_s"] is not None else s["clock"]
    if new and clock != full:
        raise RuleBroken("period_start_clock")
    if not new and s["clock"] is not None and clock is not None and clock > s["clock"]:
        if not r["correction"]:
            raise RuleBroken("clock_rose")
        clock = s["clock"]
    score = [r["home_score"], r["away_score"]]
    gain = [a - b for a, b in zip(score, s["score"], strict=True)]
    if min(gain) < 0:
        raise RuleBroken("score_fell")
    if gain[0] and gain[1]:
        raise RuleBroken("both_scored")
    offset = 1 if r["season_type"] == "POST" and r["period"] >= 5 else 0
    left = [r["home_timeouts"] + offset, r["away_timeouts"] + offset]
    reset = None
    if new:
        pair = (s["period"], r["period"])
        reset = 3 if pair == (2, 3) else 2 if pair == (4, 5) and r["season_type"] == "REG" else 3 if r["season_type"] == "POST" and r["period"] >= 5 and r["period"] % 2 else None
    base = [reset, reset] if reset is not None else s["timeouts"]
    used = [b - a for a, b in zip(left, base, strict=True)]
    if min(used) < 0 or sum(used) > 1:
        raise RuleBroken("timeouts")
    s.update(period=r["period"], clock=clock, score=score, timeouts=left)
    return s, {"home_score": score[0], "away_score": score[1], "home_timeouts": left[0], "away_timeouts": left[1]}


# --- baseball: bases, outs and innings ----------------------------------------------------------------------------------


def mlb_start() -> dict:
    return {"inning": 1, "bottom": False, "outs": 0, "bases": [None, None, None], "score": [0, 0], "ended": False}


def mlb_reduce(s: dict, r: dict) -> tuple[dict, dict]:
    """Row: inning, batting_home, outs_before, away_score, home_score, batter_id, destinations (batter, first, second, third: 0 out, 1-3 base, 4 home, null stays), outs_on_play."""
    if s["ended"]:
        raise RuleBroken("after_end")
    if s["outs"] == 3:
        s = {**s, "inning": s["inning"] + s["bottom"], "bottom": not s["bottom"], "outs": 0, "bases": [None, None, None]}
    if (r["inning"], r["batting_home"]) != (s["inning"], s["bottom"]):
        raise RuleBroken("half_inning")
    if r["outs_before"] != s["outs"]:
        raise RuleBroken("outs_before")
    if [r["away_score"], r["home_score"]] != s["score"]:
        raise RuleBroken("score_before")
    runners = [r["batter_id"], *s["bases"]]
    bases, runs = [None, None, None], 0
    for place, (who, to) in enumerate(zip(runners, r["destinations"], strict=True)):
        if who is None:
            continue
        to = place if to is None else to
        if to == 4:
            runs += 1
        elif to:
            if bases[to - 1] is not None:
                raise RuleBroken("base_taken")
            bases[to - 1] = who
    outs = s["outs"] + r["outs_on_play"]
    if outs > 3:
        raise RuleBroken("outs")
    score = list(s["score"])
    score[1 if s["bottom"] else 0] += runs
    done = s["inning"] >= 9 and score[0] != score[1] and ((outs == 3 and (s["bottom"] or score[1] > score[0])) or (s["bottom"] and score[1] > score[0]))
    s = {**s, "outs": outs, "bases": [None, None, None] if outs == 3 else bases, "score": score, "ended": done}
    return s, {"outs": outs, "away_score": score[0], "home_score": score[1]}


# --- soccer: periods, possessions, line-ups, cards, substitutions, goals ------------------------------------------------


SOCCER_PERIODS = {(1, 2), (2, 3), (2, 5), (3, 4), (4, 5)}  # fixed values: period changes that a match may make


def soccer_start() -> dict:
    return {"period": 0, "done": set(), "possession": 0, "owner": None, "on": [set(), set()], "score": [0, 0], "shootout": [0, 0]}


def soccer_reduce(s: dict, r: dict) -> tuple[dict, dict]:
    """Row: kind, period, possession, owner, side (0, 1), player, other (who comes on), players (a line-up)."""
    kind, side = r["kind"], r["side"]
    s = {**s, "done": set(s["done"]), "on": [set(x) for x in s["on"]], "score": list(s["score"]), "shootout": list(s["shootout"])}
    if kind == "line_up":
        if len(set(r["players"] or ())) != 11:
            raise RuleBroken("line_up")
        s["on"][side] = set(r["players"])
    elif kind == "start":
        if min(map(len, s["on"])) < 7 or (s["period"] == 0 and [len(x) for x in s["on"]] != [11, 11]):
            raise RuleBroken("start_without_line_ups")
        if s["period"] and ((s["period"], r["period"]) not in SOCCER_PERIODS or s["period"] not in s["done"]) and r["period"] != s["period"]:
            raise RuleBroken("period_change")
        s["period"] = r["period"]
    else:
        if r["period"] != s["period"]:
            raise RuleBroken("period_change")
        if s["period"] in s["done"]:
            raise RuleBroken("after_period_end")
        step = r["possession"] - s["possession"]
        if step not in (0, 1) or (s["possession"] == 0 and step != 1):
            raise RuleBroken("possession_step")
        if step == 0 and r["owner"] != s["owner"]:
            raise RuleBroken("possession_owner")
        s.update(possession=r["possession"], owner=r["owner"])
        if r["player"] is not None and kind != "end" and r["player"] not in s["on"][side]:
            raise RuleBroken("player_off")
        if kind == "goal":
            s["shootout" if s["period"] == 5 else "score"][side] += 1
        elif kind == "own_goal":
            s["score"][1 - side] += 1
        elif kind == "dismissal":
            s["on"][side].discard(r["player"])
        elif kind == "substitution":
            if r["other"] in s["on"][side]:
                raise RuleBroken("player_on")
            s["on"][side] = (s["on"][side] - {r["player"]}) | {r["other"]}
        elif kind == "end":
            s["done"].add(s["period"])
    return s, {"home_score": s["score"][0], "away_score": s["score"][1], "home_on": len(s["on"][0]), "away_on": len(s["on"][1])}


REDUCERS = {
    "nba": (nba_reduce, nba_start, "home_score int, away_score int, home_fouls int, away_fouls int"),
    "nfl": (nfl_reduce, nfl_start, "home_score int, away_score int, home_timeouts int, away_timeouts int"),
    "mlb": (mlb_reduce, mlb_start, "outs int, away_score int, home_score int"),
    "soccer": (soccer_reduce, soccer_start, "home_score int, away_score int, home_on int, away_on int"),
}


def season_states(rows: DataFrame, sport: str, game: str = "game_id", order: str = "sequence") -> DataFrame:
    """State after each row of every game, and each game's first violation, which ends it."""
    reduce, start, out = REDUCERS[sport]
    return checked_fold(rows, [game], [order], reduce, start, f"seq long, {out}")
