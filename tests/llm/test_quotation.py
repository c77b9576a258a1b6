import hashlib

from riskframe.llm.quotation import link_quotations, parse, with_quotations

SCHEMA = "id string, scope string, place long, text string, own string, hash binary"


def rows(spark, data):
    return spark.createDataFrame([(*d, "x", b"y") for d in data], SCHEMA).repartition(3)


def test_parse_levels():
    own, said, quoted = parse("Hi there\n\n> a B\n>c\n> > deep\n\nOn Monday Ann wrote:\n> a b c\nbye")
    h = lambda t: hashlib.md5(t.encode()).digest()
    assert own == "Hi there\n\n\nbye"
    assert said == [h("hi there"), h("bye")]
    assert quoted == [(1, h("a b c")), (2, h("deep")), (1, h("a b c"))]
    assert parse(None) == ("", [], []) == parse(" \n\t")


def test_links_trees_and_odd_rows(spark):
    data = [("a", "s", 1, "Start here"), ("b", "s", 2, "> start  HERE\n\nfirst reply"),
            ("c", "s", 3, "> Start\n> here\n\nsecond reply"), ("d", "s", 4, "> > start here\n> first reply\n\nto b"),
            ("e", "s", 5, "> nobody said this\n\nnew thread"), ("f", "t", 9, "> start here\n\nanother scope"),
            ("g", "s", 6, "Start here"), ("h", "s", 7, "> start here\n\nto the latest"), ("i", "s", 8, None),
            ("j", "s", 9, ""), (None, "s", 10, "> start here"), ("k", "s", None, "> start here\n\nno place"),
            ("b", "s", 2, "> start  HERE\n\nfirst reply"), ("z", None, 11, "> start here")]
    out = link_quotations(rows(spark, data)).collect()
    assert len(out) == len(data)
    got = {r.id: (r.root, r.depth, r.parent, r.own_text, r.quotes, r.linked) for r in out}
    assert got["a"] == ("a", 0, None, "Start here", 0, 0)
    assert got["b"] == ("a", 1, "a", "first reply", 1, 1) == got["b"]
    assert got["c"][:3] == ("a", 1, "a")
    assert got["d"] == ("a", 2, "b", "to b", 2, 2)
    assert got["e"] == ("e", 0, None, "new thread", 1, 0)
    assert got["f"][:3] == ("f", 0, None)
    assert got["h"][:3] == ("g", 1, "g")
    assert got["i"] == ("i", 0, None, "", 0, 0) and got["j"][3] == ""
    assert got["k"][:3] == ("k", 0, None) and got[None][:3] == (None, 0, None) and got["z"][1] == 0


def test_long_chain_round_trip(spark):
    turns = spark.range(100).selectExpr("id div 50 as conv_id", "id % 50 as turn",
                                        "concat('Message ', id, '\nsame line\n\nsame paragraph') as text")
    mail = with_quotations(turns).selectExpr("concat(conv_id, ':', turn) as id", "conv_id as scope", "turn as place", "mail as text")
    for r in link_quotations(mail).collect():
        assert r.depth == r.place and r.root == f"{r.scope}:0" and r.own_text.startswith(f"Message {int(r.scope) * 50 + r.place}\n")
        assert r.parent == (f"{r.scope}:{r.place - 1}" if r.place else None)


def test_empty(spark):
    assert link_quotations(spark.createDataFrame([], SCHEMA)).count() == 0
