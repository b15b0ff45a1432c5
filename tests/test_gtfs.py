"""A small feed: counts, service days, busiest days, conversion."""

import datetime

import pytest

from tramline.operators import calendar
from tramline.sources import gtfs

FEED = {
    "agency": "agency_id,agency_name,agency_url,agency_timezone\nA1,First,http://a.example,Europe/Zurich\nS42,Service 42,http://b.example,Europe/Zurich\n",
    "stops": """stop_id,stop_name,stop_lat,stop_lon,parent_station,location_type
stop1,One,46.95162082275386,7.438913082275775,,
stop2,Two,46.95153086988918,7.439162669063829,,0
stop3,Three,46.95147689809022,7.439280893956796,station1,0
stop4,Four,46.95127900232747,7.439491069338372,station1,
stop5,Five,46.9513959419576,7.439149531606609,station1,
stop6,Six,46.95121603683256,7.439359707397135,,
station1,Station,46.95127900232747,7.439491069338372,,1
entrance1,Station Entrance,46.95127900232430,7.439491069338999,station1,2
node1,Node1,46.95127900232643,7.43949106933847,station1,3
node2,Node2,,,station1,3
boarding1,Boarding,46.95162082275999,7.438913082275123,stop1,4
boarding2,stop2,,,stop2,4
""",
    "calendar": "service_id,monday,tuesday,wednesday,thursday,friday,saturday,sunday,start_date,end_date\nWEEK,1,1,1,1,1,0,0,20181001,20181007\nEXPR,0,0,0,0,0,0,0,20181001,20181007\nWEND,0,0,0,0,0,1,1,20181001,20181007\nEMPT,1,0,1,1,0,1,0,20181001,20181007\n",
    "calendar_dates": "service_id,date,exception_type\nWEEK,20181006,2\nWEEK,20181007,2\nEXPR,20181005,1\nEMPT,20181002,1\nEMPT,20181001,2\n",
    "routes": "route_id,route_short_name,route_long_name,route_type,agency_id\nlineA,Line A,Bus Line A,3,S42\nlineB,Line B,Tram Line B,0,A1\nlineC,Line C,Something else,907,A1\n",
    "trips": "route_id,service_id,trip_id,shape_id\nlineA,WEEK,routeA1,shapeA1\nlineA,WEEK,routeA2,shapeA2\nlineB,EXPR,routeB,B\nlineA,WEND,routeA1_weekend,shapeA1\nlineA,WEND,routeA2_weekend,shapeA2\nlineB,WEND,routeB_weekend,B\n",
    "stop_times": "trip_id,arrival_time,departure_time,stop_id,stop_sequence\n"
    + "".join(
        f"{t},{a},{a},{s},{k}\n"
        for t, rows in {
            "routeA1": [("00:00:00", "stop1", 1), ("00:00:20", "stop2", 2), ("00:00:40", "stop3", 3), ("00:01:20", "stop4", 4)],
            "routeA2": [("00:01:20", "stop1", 4), ("00:01:00", "stop2", 3), ("00:00:40", "stop3", 2), ("00:00:00", "stop4", 1)],
            "routeB": [("00:00:00", "stop1", 1), ("00:01:20", "stop3", 2), ("", "stop5", 3), ("00:02:20", "stop6", 4), ("00:02:40", "stop4", 5)],
            "routeA1_weekend": [("00:00:00", "stop1", 1), ("00:00:30", "stop2", 2)],
            "routeA2_weekend": [("00:00:00", "stop4", 1), ("00:00:30", "stop3", 2)],
            "routeB_weekend": [("00:00:00", "stop1", 1), ("24:01:00", "stop3", 2)],
        }.items()
        for a, s, k in rows
    ),
    "frequencies": "trip_id,start_time,end_time,headway_secs,exact_times\nrouteA1,08:00:00,14:00:01,10800,0\nrouteA2,09:00:00,15:00:01,10800,0\nrouteB,07:00:00,16:00:01,10800,0\n",
    "shapes": "shape_id,shape_pt_lon,shape_pt_lat,shape_pt_sequence\nB,7.43,46.95,1\nB,7.44,46.95,2\n",
    "transfers": "from_stop_id,to_stop_id,transfer_type,min_transfer_time\nstop3,stop4,2,10\nstop4,stop3,2,10\nstop2,stop3,0,\nstop1,stop2,3,\nstop1,stop9,1,\n",
}


def write(folder, **changes):
    for name, text in (FEED | changes).items():
        if text is not None:
            (folder / f"{name}.txt").write_text("﻿" + text if name == "agency" else text)
    return str(folder)


@pytest.fixture
def feed(spark, tmp_path):
    return gtfs.load(spark, write(tmp_path))


def test_tables(feed):
    assert [feed.stops.count(), feed.stops.where("location_type = 0").count(), feed.routes.count(), feed.services.count(), feed.shapes.count(), feed.trips.count(), feed.agency.count()] == [12, 6, 3, 4, 1, 6, 2]
    where = {r["stop_id"]: (r["lat"], r["lon"]) for r in feed.stops.collect()}
    assert where["node2"] == where["station1"] and where["boarding2"] == where["stop2"]
    assert {r["route_id"]: r["mode"] for r in feed.routes.collect()} == {"lineA": "bus", "lineB": "tram", "lineC": "other"}
    assert feed.stop_times.where("stop_id = 'stop5'").first()["arrival"] == 80
    assert feed.stop_times.agg({"arrival": "max"}).first()[0] == 86460
    assert feed.trips.where("shape_id IS NOT NULL").count() == 2


def test_days(feed):
    days = {(r["service_id"], r["date"].day) for r in calendar.service_days(feed.services).collect()}
    assert {d for s, d in days if s == "EMPT"} == {2, 3, 4, 6} and {d for s, d in days if s == "EXPR"} == {5}
    assert gtfs.sample_date(feed, "dayWithMostServices") == datetime.date(2018, 10, 2)
    assert gtfs.sample_date(feed, "dayWithMostTrips") == datetime.date(2018, 10, 5)
    assert gtfs.sample_date(feed, "all") is None
    with pytest.raises(ValueError, match="not a date"):
        gtfs.sample_date(feed, "tomorrow")


def test_conversion(feed):
    s = gtfs.to_schedule(gtfs.projected(feed, "EPSG:2056"), "20181005")
    assert s["stops"].count() == 6 and s["route_stops"].select("route_id").distinct().count() == 3
    assert {r["line_id"]: (r["numTransitRoutes"], r["totalDepartures"]) for r in s["info"].collect()} == {"lineA": (2, 6), "lineB": (1, 4), "lineC": (0, 0)}
    at = {r["stop_id"]: (round(r["x"]), round(r["y"])) for r in s["stops"].collect()}
    assert abs(at["stop1"][0] - 2600021) <= 1 and abs(at["stop1"][1] - 1200060) <= 1 and abs(at["stop6"][0] - 2600055) <= 1
    assert {(r["from_stop"], r["to_stop"]): r["min_time"] for r in s["transfers"].collect()} == {("stop3", "stop4"): 10, ("stop4", "stop3"): 10, ("stop2", "stop3"): 0}
    b = {r["idx"]: (r["arrival_offset"], r["departure_offset"]) for r in s["route_stops"].where("route_id = 'routeB'").collect()}
    assert b == {1: (0, 0), 2: (80, 80), 3: (80, 80), 4: (140, 140), 5: (160, 0)}
    assert "routeA1_08:00:00" in {r["departure_id"] for r in s["departures"].collect()}


@pytest.mark.parametrize(
    ("changes", "said"),
    [
        ({"calendar": None, "calendar_dates": None}, "calendar"),
        ({"agency": "agency_name,agency_url,agency_timezone\na,b,c\nd,e,f\n"}, "several agencies"),
        ({"stops": "stop_id,stop_lat\nx,1\n"}, "missing columns"),
        ({"routes": "route_id,route_type\nlineA,3\nlineB,0\n"}, "without a name"),
        ({"stop_times": FEED["stop_times"] + "nowhere,00:00:00,00:00:00,stop1,1\n"}, "unknown trip"),
        ({"transfers": "from_stop_id,to_stop_id,transfer_type,min_transfer_time\nstop3,stop4,2,\n"}, "without a time"),
    ],
)
def test_invalid_feeds(spark, tmp_path, changes, said):
    with pytest.raises(Exception, match=said):  # noqa: PT011, PT012
        f = gtfs.load(spark, write(tmp_path, **changes))
        [t.collect() for t in (f.stops, f.routes, f.stop_times, f.transfers)]


def test_small_feeds(spark, tmp_path):
    f = gtfs.load(spark, write(tmp_path, calendar=None, frequencies=None, transfers=None, shapes=None, agency="agency_name,agency_url,agency_timezone\nOnly,b,c\n", routes="route_id,route_long_name,route_type\nlineA,Long,3\n", trips="\n".join(x for x in FEED["trips"].split("\n") if "WEND" not in x), stop_times="\n".join(x for x in FEED["stop_times"].split("\n") if "weekend" not in x)))
    assert f.routes.first()["agency_id"] == "Only" and f.routes.first()["short_name"] == "Long" and f.services.count() == 3
    assert f.trips.count() == 2 and f.stop_times.count() == 8
