"""A small timetable in positional files."""

import pytest

from tramline.operators import hafas_schedule as H
from tramline.sources import hafas

FILES = {
    "BFKOORD_WGS": "* comment\n8508350   8.0380890  46.7552140 566    % Brienz BRB\n8508351   8.0198450  46.7723730 1346   % Planalp\n8508352   8.0384470  46.7873990 2252   % Brienzer Rothorn\n",
    "BETRIEB_DE": '* comment\n00075 K "BRB" L "BRB" V "Brienz Rothorn Bahn AG"\n00075 : 000104\n',
    "BITFELD": "* comment\n003499 F" + "0" * 95 + "\n003500 0F" + "0" * 94 + "\n",
    "DURCHBI": "*DURCHBI\n000001 000104 8508352 000002 000104 003499\nshort\n00000x 000104 8508352 000002 000104 003499\n",
    "UMSTEIGB": "9999999 02 02 STANDARD\n8508350 05 05 Brienz BRB\n8508351 06 06 Planalp\n",
    "METABHF": "8508350 8508351 060\n*A Y\n8508350 8503000 999\n9438000:  9438000  9442002\n",
    "ECKDATEN": "* comment\n10.12.2017\n08.12.2018\n",
    "FPLAN": """*Z 000001 000104   001                                    %
*G R   8508350 8508352  00730  00825                      %
*A VE 8508350 8508352 003499  00730  00825                %
*R                                                        %
8508350 Brienz BRB                   00730                %
8508351 Planalp               00756  00756                %
8508352 Brienzer Rothorn      00825                       %
*Z 000002 000104   001 002 030                            %
*G R   8508352 8508350  00906  01008                      %
*A VE 8508352 8508351 003500  00906  01008                %
*A VE 8508351 8508350 003499  00906  01008                %
8508352 Brienzer Rothorn             00906                %
8508351 Planalp               00938  00941                %
8508353 Pass through         -00950 -00951                %
8508350 Brienz BRB            01008                       %
""",
}


@pytest.fixture
def folder(tmp_path):
    for name, text in FILES.items():
        (tmp_path / name).write_text(text)
    return str(tmp_path)


def test_tables(spark, folder):
    assert [tuple(r) for r in hafas.stops(spark, f"{folder}/BFKOORD_WGS").orderBy("stop_id").take(1)] == [("8508350", 8.038089, 46.755214, "Brienz BRB")]
    assert hafas.operators(spark, f"{folder}/BETRIEB_DE").collect() == [("000104", "BRB", "Brienz Rothorn Bahn AG")]
    assert hafas.through_services(spark, f"{folder}/DURCHBI").collect() == [(1, "000104", "8508352", 2, "000104", 3499)]
    first = hafas.period(spark, f"{folder}/ECKDATEN").first()
    assert (first["first"].isoformat(), first["last"].isoformat()) == ("2017-12-10", "2018-12-08")
    fields = hafas.bitfields(spark, f"{folder}/BITFELD")
    assert {r[0] for r in hafas.valid_on(fields, 0).collect()} == {0, 3499} and {r[0] for r in hafas.valid_on(fields, 2).collect()} == {0, 3500}
    stops = hafas.stops(spark, f"{folder}/BFKOORD_WGS")
    t = {(r["from_stop"], r["to_stop"]): r["min_time"] for r in hafas.transfers(spark, f"{folder}/UMSTEIGB", f"{folder}/METABHF", stops).collect()}
    assert t == {("8508350", "8508350"): 300, ("8508351", "8508351"): 360, ("8508350", "8508351"): 3600}


def test_trips(spark, folder):
    trips = hafas.trips(spark, f"{folder}/FPLAN")
    a, b = trips.orderBy("number").collect()
    assert (a["number"], a["operator_code"], a["category"], a["cycles"]) == ("000001", "000104", "R", 0) and [s["stop_id"] for s in a["stops"]] == ["8508350", "8508351", "8508352"]
    assert (b["cycles"], b["cycle_minutes"], len(b["stops"]), len(b["validity"])) == (2, 30, 3, 2) and b["stops"][0]["departure"] == 9 * 3600 + 360
    times = {(r["number"], r["departure_id"]): r["time"] for r in H.departures(trips).collect()}
    assert times == {("000001", "000001"): 26940, ("000002", "000002_0"): 32700, ("000002", "000002_1"): 34500, ("000002", "000002_2"): 36300}
    stops = [(r["arrival_offset"], r["departure_offset"]) for r in H.route_stops(trips.where("number = '000001'")).orderBy("idx").collect()]
    assert stops == [(0, 60), (1620, 1620), (3360, 3420)]


def test_sections_and_filters(spark, folder):
    trips = hafas.trips(spark, f"{folder}/FPLAN")
    part = {r["number"]: [s["stop_id"] for s in r["stops"]] for r in H.valid_stops(trips, [3499]).collect()}
    assert part == {"000001": ["8508350", "8508351", "8508352"], "000002": ["8508351", "8508350"]}
    both = {r["number"]: len(r["stops"]) for r in H.valid_stops(trips, []).collect()}
    assert both == {"000001": 3, "000002": 3}
    kept, dropped = H.filtered(trips, [H.on_bitfields([3500]), H.of_category(["R"]), H.at_stops(["8508352"])])
    assert [r["number"] for r in kept.collect()] == ["000002"] and dropped.count() == 1
    for which, n in (("first", 1), ("first_or_last", 2), ("any", 2), ("all", 0)):
        assert trips.where(H.at_stops(["8508350"], which)).count() == n
    pairs = H.chained(hafas.through_services(spark, f"{folder}/DURCHBI"), H.departures(trips), trips, [3499]).collect()
    assert [(r["first_departure"], r["second_departure"]) for r in pairs] == [("000001", "000002_0")]
    assert H.busiest_block(hafas.bitfields(spark, f"{folder}/BITFELD"), trips).first() == (0, 4)


def test_edges(spark, tmp_path):
    (tmp_path / "KANTEN").write_text("1 2 B\n*G 3\n*G 4\n2 5\n")
    (tmp_path / "STRECKENPT").write_text("".join(f"{i} {i}.0 0.0\n" for i in (1, 2, 3, 4)))
    nodes = hafas.points(spark, str(tmp_path / "STRECKENPT"))
    links = {r["link_id"] for r in hafas.edges(hafas.edge_lines(spark, str(tmp_path / "KANTEN")), nodes).collect()}
    assert links == {"1_3", "3_4", "4_2", "3_1", "4_3", "2_4"}
