"""Raw events with versions, filling by need, and sets that are published together."""

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tallyspark.operators import enrichment as N
from tallyspark.operators import matches as X
from tallyspark.sources import publication as U
from tallyspark.sources import raw
from tallyspark.sources import tables as I


def _event(kind, player=1, location=(10.0, 20.0), **more):
    return {"id": "e", "index": 1, "type": {"name": kind}, "player": None if player is None else {"id": player}, "location": location and list(location), **more}


def _reduced(spark, events):
    lines = spark.createDataFrame([(1, e if isinstance(e, str) or e is None else json.dumps(e)) for e in events], "match_id long, line string")
    return raw.actions(raw.event_texts(lines, "line"), ["match_id"])


def test_only_open_play_moves_count(spark):
    end = {"end_location": [50.0, 40.0]}
    done, missed, corner, carry, nowhere, press = _reduced(
        spark,
        [
            _event("Pass", **{"pass": end}), _event("Pass", **{"pass": end | {"outcome": {"name": "Incomplete"}}}), _event("Pass", **{"pass": end | {"type": {"name": "Corner"}}}),
            _event("Carry", carry=end), _event("Carry", carry={"end_location": [3.0]}), _event("Pressure"),
        ],
    ).select("move").collect()
    assert (done.move.completed, done.move.end_x, missed.move.completed, corner.move, carry.move.end_y, press.move) == (True, 50.0, False, None, 40.0, None)
    assert nowhere.move.completed and nowhere.move.end_x is None


def test_shots_are_recoded_and_placeless_events_dropped(spark):
    shot = {"outcome": {"name": "Off T"}, "type": {"name": "Penalty"}, "body_part": {"name": "Left Foot"}, "xg": 0.76}
    rows = _reduced(spark, [_event("Shot", shot=shot), _event("Shot"), _event("Shot", player=None), _event("Shot", location=(5.0,)), _event("Shot", location=None)]).select("shot.*").collect()
    assert [tuple(r) for r in rows] == [(0.76, "off-target", 1, "left-foot"), (0.0, "other", 0, "other")]


def test_lines_that_are_no_event_are_set_apart(spark):
    lines = ['{"id": "a", "type": {"name": "Pass"}}', '{"id": "b", "type"', "", None, "[]x", '{"id": "c", "unknown": {"deep": [1, 2]}}']
    got = raw.event_texts(spark.createDataFrame([(k, x) for k, x in enumerate(lines)], "k int, line string"), "line").orderBy("k").collect()
    assert [r.corrupt is None for r in got] == [True, False, False, False, False, True]
    assert [got[1].corrupt, got[2].corrupt, got[3].corrupt] == [lines[1], "", ""] and got[5].id == "c"
    assert raw.event_texts(spark.createDataFrame([], "k int, line string"), "line").count() == 0


def test_files_by_version_feed_the_same_reduction(spark, tmp_path):
    for match, version, events in ((7, 1, [_event("Pressure"), _event("Pressure")]), (7, 2, [_event("Pressure", location=(100.0, 10.0))]), (8, 1, [_event("Shot", player=2)])):
        folder = tmp_path / f"match_id={match}" / f"version={version}"
        folder.mkdir(parents=True)
        (folder / "events.json").write_text("\n".join([*map(json.dumps, events), '{"broken"']))
    files = raw.event_files(spark, str(tmp_path))
    last = raw.newest(files)
    assert sorted((r.match_id, r.version, r.n, r.broken) for r in last.groupBy("match_id", "version").agg(F.count("*").alias("n"), F.count("corrupt").alias("broken")).collect()) == [(7, 2, 2, 1), (8, 1, 2, 1)]
    reduced = X.reduced_events(raw.actions(last, ["match_id"]), ["match_id", "player"])
    assert sorted(map(tuple, reduced["cells"].select("match_id", "player", "n").collect())) == [(7, 1, 1), (8, 2, 1)]
    wanted = spark.createDataFrame([(7,), (8,), (9,)], "match_id long")
    assert sorted(r.match_id for r in raw.outdated(wanted, files, 2).collect()) == [8, 9]
    assert sorted(r.match_id for r in raw.outdated(wanted, files.limit(0), 2).collect()) == [7, 8, 9]
    pruned = files.filter("match_id = 8")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(match_id" in pruned


SQUADS = [
    (1, 10, "Joselu", "Spain"), (1, 11, None, "Italy"), (2, 10, "Other", "France"), (2, 12, " ", ""), (3, 13, "Duda", None),
    (4, 13, "Later", "Brazil"), (5, 14, "Ana", "Peru"), (5, 14, "Zoe", "Chile"), (6, 99, "Nobody", "None"),
]
GAMES = [(1, "a"), (2, "a"), (3, "b"), (4, "b"), (5, "b"), (6, "c")]
PLAYERS = [(10, None, None), (11, "Own", None), (12, None, None), (13, None, None), (14, None, "Kept"), (15, "Whole", "Known"), (None, None, None)]


def _scan(spark, path, portion=50, players=PLAYERS, log=None):
    squads = spark.createDataFrame(SQUADS, "match_id long, player long, nickname string, country string")
    games = spark.createDataFrame(GAMES, "match_id long, competition string")

    def read(some):
        if log is not None:
            log.append(sorted(r.match_id for r in some.collect()))
        return squads.join(some, "match_id")

    frame = spark.createDataFrame(players, "player long, nickname string, country string")
    did = N.scan_by_need(frame, squads.join(games, "match_id"), games, read, ["nickname", "country"], path, portion)
    return did, N.filled_from_scan(frame, I.artifact(spark, path), ["nickname", "country"])


def test_the_first_match_by_need_fills_whatever_the_portion(spark, tmp_path):
    found = []
    for portion in (1, 50):
        did, filled = _scan(spark, str(tmp_path / str(portion)), portion)
        assert (did.seen, did.pending) == (5, 0)
        found.append({r.player: (r.nickname, r.country) for r in filled.collect()})
    assert found[0] == found[1]
    assert found[0] == {10: ("Joselu", "Spain"), 11: ("Own", "Italy"), 12: (None, None), 13: ("Duda", None), 14: ("Ana", "Kept"), 15: ("Whole", "Known"), None: (None, None)}


def test_the_scan_ends_when_nobody_is_pending(spark, tmp_path):
    log = []
    did, _ = _scan(spark, str(tmp_path / "x"), 1, log=log)
    assert log[:2] == [[1], [2]] and [6] not in log and did.matches == len(log) < len(GAMES) + 1
    again = []
    did, _ = _scan(spark, str(tmp_path / "x"), 1, log=again)
    assert again == [] and did == N.Scan(0, 0, 0)


def test_a_scan_goes_on_where_it_was_ended(spark, tmp_path):
    path = str(tmp_path / "x")
    _scan(spark, path, 1, [p for p in PLAYERS if p[0] in (10, 11)])
    did, filled = _scan(spark, path, 1)
    assert did.seen == 3 and did.pending == 0
    assert {r.player: r.country for r in filled.filter("player is not null").collect()} == {10: "Spain", 11: "Italy", 12: None, 13: None, 14: "Kept", 15: "Known"}


def test_a_scan_of_nothing(spark, tmp_path):
    did, filled = _scan(spark, str(tmp_path / "x"), players=[(77, None, None)])
    assert did == N.Scan(6, 0, 1) and filled.first().nickname is None
    did, _ = _scan(spark, str(tmp_path / "y"), players=[])
    assert did == N.Scan(0, 0, 0)


def test_a_failed_publication_leaves_the_set_before_it(spark, tmp_path):
    folder = str(tmp_path)
    rows = lambda *n: spark.createDataFrame([(x,) for x in n], "n int")
    state = lambda pool: U.stale(spark, folder, rows(*range(pool)), "m2").first()
    assert U.published(spark, folder, "a") is None and state(3).stale and state(3).mismatched
    U.publish(spark, folder, {"a": U.Artifact(rows(1, 2)), "b": U.Artifact(rows(3))}, 100, "m1")
    with pytest.raises(U.Refused, match="positive"):
        U.publish(spark, folder, {"a": U.Artifact(rows(5)), "b": U.Artifact(rows(-1), {"positive": F.col("n") > 0})}, 500, "m2")
    with pytest.raises(U.Refused, match="no rows"):
        U.publish(spark, folder, {"a": U.Artifact(rows(5)), "b": U.Artifact(rows())}, 500, "m2")
    with pytest.raises(Exception, match="(?i)divi"):
        U.publish(spark, folder, {"a": U.Artifact(rows(5)), "b": U.Artifact(rows(0).select((1 / F.col("n")).alias("n")))}, 500, "m2")
    assert sorted(r.n for r in U.published(spark, folder, "a").collect()) == [1, 2] and U.current(spark, folder).pool == 100
    assert [(state(n).stale, state(n).mismatched) for n in (94, 95, 105, 106)] == [(True, True), (False, True), (False, True), (True, True)]
    U.publish(spark, folder, {"a": U.Artifact(rows(9)), "c": U.Artifact(rows(), may_be_empty=True)}, 94, "m2")
    assert [r.n for r in U.published(spark, folder, "a").collect()] == [9] and U.published(spark, folder, "b") is None and U.published(spark, folder, "c").count() == 0
    assert (state(94).stale, state(94).mismatched, U.manifest(spark, folder).count()) == (False, False, 2)


@pytest.mark.skipif(not Path("/root/testdata/sf0.01").exists(), reason="the driver's tables are absent")
def test_portions_grow_with_the_matches(spark, monkeypatch):
    """Ten times the matches take no more portions, so no more jobs."""
    from tallyspark.plans import feeds

    cut, portions = [], N._portions
    monkeypatch.setattr(N, "_portions", lambda *a: cut.append(portions(*a)) or cut[-1])
    assert feeds.filled_by_need(spark, "/root/testdata/sf0.01").count()
    assert sum(map(len, cut[0].values())) <= feeds.PORTIONS + len(cut[0])
