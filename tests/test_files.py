"""Readers on small files."""

import base64
import hashlib
import json

from feedlab.sources import files


def test_raw_segments_and_manifests(spark, tmp_path):
    folder = tmp_path / "source=s" / "stream=t" / "date=2026-06-01" / "hour=3"
    folder.mkdir(parents=True)
    line = lambda n, hour, ok: json.dumps({"capture_session_id": "x", "record_ordinal": n, "receive_at": f"2026-06-01T{hour:02d}:00:01Z", "payload_base64": base64.b64encode(b"p").decode(), "payload_sha256": hashlib.sha256(b"p" if ok else b"q").hexdigest()})
    (folder / "a.jsonl").write_text("\n".join([line(1, 3, True), line(2, 3, False), line(4, 4, True)]))
    good, bad = files.read_raw_segments(spark, f"file://{tmp_path}")
    assert [bytes(r.payload) for r in good.collect()] == [b"p"]
    assert {r.record_ordinal: list(r.reasons) for r in bad.collect()} == {2: ["hash"], 4: ["ordinal", "hour"]}
    (folder / "m.json").write_text(json.dumps({"source": "s", "stream": "t", "date": "2026-06-01", "hour": 4}))
    assert [x.count() for x in files.read_manifests(spark, f"file://{tmp_path}")] == [0, 1]


def test_pairs_races_and_rows(spark, tmp_path):
    (tmp_path / "p.csv").write_text("pair_id,left_market_id,right_market_id,relation_type,confidence,router_version,observed_at\n1,a,b,identity,0.50,v,t\n2,c,d,mutex,1e0,v,t\n3,e,f,mutex,1,v,t\n4,f,e,mutex,1,v,t\n")
    good, bad = files.read_pairs_csv(spark, f"file://{tmp_path}/p.csv")
    assert [r.pair_id for r in good.collect()] == ["1"] and {r.pair_id for r in bad.collect()} == {"2", "3", "4"}
    (tmp_path / "r.json").write_text(json.dumps({"MRData": {"RaceTable": {"Races": [{"season": "2025", "round": "1", "Results": [{"position": "1"}, {"position": "2"}]}]}}}))
    assert [(r["round"], r["item"]["position"]) for r in files.flatten_race_results(spark, f"file://{tmp_path}/r.json", "Results").collect()] == [(1, "1"), (1, "2")]
    (tmp_path / "m.csv").write_text("game_id,event_index\ng,1\ng,2\nh,2\n")
    rows, bad = files.read_rows_csv(spark, f"file://{tmp_path}/m.csv", "game_id string, event_index int", "game_id", "event_index")
    assert rows.count() == 3 and [r.game_id for r in bad.collect()] == ["h"]


def test_seasons_and_matches(spark, tmp_path):
    row = lambda season, n: [(season, f"g{n}", n, "extra")]
    for i, rows in enumerate([row(2023, 1) + row(2023, 2), row(2024, 3), row(2024, 4) + row(2025, 5), row(None, 6)]):
        spark.createDataFrame(rows, "season int, game_id string, play_id int, other string").coalesce(1).write.parquet(f"file://{tmp_path}/s{i}")
    rows, bad = files.read_pbp_seasons(spark, [f"file://{tmp_path}/s{i}" for i in range(4)], {"season": "int", "play_id": "int", "absent": "string"})
    assert rows.columns == ["season", "play_id", "absent"] and rows.count() == 6
    assert sorted((r["seasons"], r["unknown"]) for r in bad.collect()) == [(0, 1), (2, 0)]
    match = lambda i: {"match_id": i, "match_date": "2026-01-01", "home_team": {"home_team_id": 1, "home_team_name": "h"}, "home_score": 2}
    (tmp_path / "matches.json").write_text(json.dumps([match(1), match(2), match(2)]))
    matches, again = files.read_match_index(spark, f"file://{tmp_path}/matches.json")
    assert matches.count() == 3 and [r["match_id"] for r in again.collect()] == [2] and matches.first()["home_team"]["home_team_name"] == "h"
    (tmp_path / "events").mkdir()
    event = lambda i, n: {"id": i, "index": n, "period": 1, "type": {"id": 1, "name": "Pass"}}
    (tmp_path / "events" / "77.json").write_text(json.dumps([event("a", 1), event("b", 2), event("b", 4)]))
    (tmp_path / "events" / "78.json").write_text(json.dumps([event("a", 1)]))
    events, bad = files.read_match_events(spark, f"file://{tmp_path}/events")
    assert sorted((r["match_id"], r["index"]) for r in events.collect()) == [(77, 1), (77, 2), (77, 4), (78, 1)]
    assert {(r["index"], tuple(r["reasons"])) for r in bad.collect()} == {(2, ("id",)), (4, ("index", "id"))}
