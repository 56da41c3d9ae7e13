"""Sources and parsers on literal inputs."""

import json

from pyspark.sql import functions as F

from delaylens.operators import events as EV
from delaylens.session import scratch_path
from delaylens.sources import files as IO
from delaylens.sources import parsing as PX


def test_stops_from_geojson(spark):
    doc = {"features": [
        {"properties": {"gtfs_stop_id": "U1Z1P", "stop_name": "One"}, "geometry": {"coordinates": [14.1, 50.1]}},
        {"properties": {"stop_id": "U2S1", "stop_name": "Two"}, "geometry": {"coordinates": [14.2, 50.2]}},
        {"properties": {"gtfs_stop_id": "U3Z1P", "stop_name": "Three"}, "geometry": None},
        {"properties": {"gtfs_stop_id": "U4Z1P", "stop_name": "Four"}, "geometry": {"coordinates": []}},
        {"properties": {"gtfs_stop_id": "U5Z1P"}, "geometry": {"coordinates": [1.0, 2.0]}},
    ]}
    df = spark.createDataFrame([(json.dumps(doc),)], "value string")
    got = sorted((r["gtfs_stop_id"], r["stop_name"]) for r in PX.stops_from_geojson(df).collect())
    assert got == [("U1Z1P", "One"), ("U2S1", "Two")]


PAGE = """<html><body>
<div class="e-tables-table-overview__row">
 <div class="e-tables-table-overview__cell--league">Liga</div>
 <div class="e-tables-table-overview__cell--round">4. kolo</div>
 <div class="x e-tables-table-overview__cell--gray">a</div><div class="e-tables-table-overview__cell--gray">b</div>
 <div class="e-tables-table-overview__cell--gray">02.05.2031</div><div class="e-tables-table-overview__cell--gray">17:45</div>
 <div class="e-tables-table-overview__result-team-label">Sparta Praha</div>
 <div class="e-tables-table-overview__result-team-label">SK Alder</div>
 <span class="e-tables-table-overview__result-score-inner">5:3</span>
</div>
<div class="e-tables-table-overview__row">
 <div class="e-tables-table-overview__result-team-label">FK Birch</div>
 <div class="e-tables-table-overview__result-team-label">Sparta Praha</div>
</div>
<div class="e-tables-table-overview__row">
 <div class="e-tables-table-overview__result-team-label">A</div>
 <div class="e-tables-table-overview__result-team-label">B</div>
</div>
</body></html>"""


def test_matches_from_html(spark):
    pages = spark.createDataFrame([(1, PAGE)], "page_id long, html string")
    rows = PX.matches_from_html(pages).orderBy("block_no").collect()
    assert len(rows) == 3
    a, b, c = rows
    assert (a["Competition"], a["Round"], a["Date"], a["Time"], a["Score"]) == \
        ("Liga", "4. kolo", "02.05.2031", "17:45", "5:3")
    assert (a["is_home"], a["Opponent"], a["Location"]) == (True, "SK Alder", "D")
    assert (b["is_home"], b["Opponent"], b["Location"], b["Date"], b["Score"]) == \
        (False, "FK Birch", "V", "", "- : -")
    assert (c["is_home"], c["Opponent"], c["Location"]) == (None, "Unknown", "Neutral")


def test_stop_id_list_keeps_unparsable_text(spark):
    stops = spark.createDataFrame([("['U187Z1P', 'U187Z2P']",), ("['U439Z1P']",), ("U999 broken",),
                                   ("['U187Z1P']",)], "all_stop_ids string")
    got = [r[0] for r in IO.stop_id_list(stops).collect()]
    assert got == ["U187Z1P", "U187Z2P", "U439Z1P", "U999 broken"]


def test_read_matches_both_formats(spark):
    path = scratch_path(spark, "m-csv")
    lines = [",".join(IO.MATCH_CSV_COLUMNS),
             "Sparta Praha,SK Alder,SK Alder,True,Liga,4. kolo,02.05.2031,17:45,5:3,D,02.05.2031 17:45",
             "Sparta Praha,SK Cedar,SK Cedar,True,Liga,9. kolo,11.06.2031,?,- : -,D,11.06.2031 ?",
             "FK Dogwood,Sparta Praha,FK Dogwood,False,,,,,1:4,V, "]
    IO.write_lines(spark, lines, path)
    cal = IO.read_matches(spark, path).collect()
    assert len(cal) == 1 and cal[0]["is_home"] is True and cal[0]["kickoff_hour"] == 17
    path2 = scratch_path(spark, "m-semi")
    IO.write_lines(spark, ["x;Location;Date;Time;Opponent", "1; D ;01.02.2025;18:00;", "2;V;02.02.2025;20:30;B"],
                   path2)
    cal2 = IO.read_matches_semicolon(spark, path2).orderBy("kickoff").collect()
    assert [(r["is_home"], r["Opponent"]) for r in cal2] == [(True, "TBD"), (False, "B")]


def test_upsert_partial_overlap(spark):
    ex = spark.createDataFrame([("U1", "old1"), ("U2", "old2")], "base_stop_id string, stop_name string")
    up = spark.createDataFrame([("U2", "new2"), ("U3", "new3")], "base_stop_id string, stop_name string")
    got = sorted(tuple(r) for r in IO.upsert_stops(ex, up).collect())
    assert got == [("U1", "old1"), ("U2", "new2"), ("U3", "new3")]


def test_past_matches_and_value_counts(spark):
    from delaylens.sources.fixtures import match_rows
    cal = EV.match_calendar(match_rows(spark))
    past = EV.past_matches(cal, "2024-01-12").collect()
    assert [r["label"] for r in past] == ["06.01.2024 - FK Alpha (Home)", "10.01.2024 - FC Beta (Away)"]
    counts = {r["is_home"]: r["matches"] for r in EV.match_value_counts(cal, "is_home").collect()}
    assert counts == {True: 2, False: 2}


def test_incremental_rows_threshold(spark):
    import datetime as dt
    tgt = spark.createDataFrame([(dt.datetime(2024, 1, 1, 10, 0, 0, 700000),)],
                                "current_stop_departure timestamp_ntz")
    src = spark.createDataFrame([(dt.datetime(2024, 1, 1, 10, 0, 0, 900000),),
                                 (dt.datetime(2024, 1, 1, 10, 0, 1),),
                                 (dt.datetime(2024, 1, 1, 10, 0, 1, 1),)],
                                "current_stop_departure timestamp_ntz")
    assert IO.incremental_rows(tgt, src).count() == 1          # after trunc(mark + 1 s)
    assert IO.incremental_rows(tgt, src, exact=True).count() == 3
    assert IO.incremental_rows(None, src).count() == 3
