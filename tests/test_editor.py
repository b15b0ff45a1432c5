import pytest

from tramline.operators import editor
from tramline.operators.editor import Schedule


@pytest.fixture
def schedule(spark):
    links = [(x, x[0], x[1], 1.0) for x in "AB BC CD DE BX XC XD AE EA".split()]
    return Schedule(
        spark.createDataFrame([("l", "r", ["AB", "BC", "CD", "DE"])], "line_id string, route_id string, link_ids array<string>"),
        spark.createDataFrame([("l", "r", 0, "s.link:AB"), ("l", "r", 1, "t.link:DE")], "line_id string, route_id string, idx int, stop_id string"),
        spark.createDataFrame([("s.link:AB", "s", "AB"), ("t.link:DE", "t", "DE")], "stop_id string, parent string, link_id string"),
        spark.createDataFrame(links, "link_id string, from_node string, to_node string, cost double"),
    )


def ids(s):
    return s.routes.first()["link_ids"]


def test_commands(schedule):
    assert ids(editor.run(schedule, [["// a comment"], ["rerouteViaLink", "l", "r", "BC", "XC"], [""]])) == ["AB", "BX", "XC", "CD", "DE"]
    assert ids(editor.run(schedule, [["rerouteFromStop", "l", "r", "s", "XD"]])) == ["AB", "BX", "XD", "DE"]
    moved = editor.run(schedule, [["changeRefLink", "t.link:DE", "CD"]])
    assert ids(moved) == ["AB", "BC", "CD"] and moved.stops.where("stop_id = 't.link:CD'").count() == 1
    assert ids(editor.run(schedule, [["changeRefLinkOnLink", "BC", "s", "BC"]])) == ["BC", "CD", "DE"]
    short = editor.run(schedule, [["addLink", "BD", "B", "D", "BC"]])
    assert ids(short) == ["AB", "BD", "DE"]
    assert ids(editor.without_mapping(schedule)) is None


@pytest.mark.parametrize(("command", "said"), [(["fly"], "unknown"), (["addLink", "a"], "arguments"), (["rerouteViaLink", "l", "r", "ZZ", "XC"], "doesn't use")])
def test_bad_commands(schedule, command, said):
    with pytest.raises(ValueError, match=said):
        editor.run(schedule, [command])
