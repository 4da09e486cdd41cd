"""Pointer doubling against walking up: a chain of 1,000, a bush, a cycle with a tail, missing parents."""

from siltstone.operators import trees as T


def test_chain_bush_and_cycle(spark):
    rows = [(f"c{i}", f"c{i - 1}" if i else None, f"n{i}") for i in range(1000)]
    rows += [(f"b{i}", "c3", "b") for i in range(50)] + [("lost", "nowhere", "l"), ("below lost", "lost", "m")]
    rows += [(f"r{i}", f"r{(i + 1) % 5}", "r") for i in range(5)] + [("tail", "r2", "t"), ("tail end", "tail", "u"), ("self", "self", "s")]
    parent, name = {t: p for t, p, _ in rows}, {t: n for t, _, n in rows}
    got = {r.tag: r for r in T.ancestry(spark.createDataFrame(rows, "tag string, parent string, name string").repartition(3)).collect()}
    assert len(got) == len(rows)
    for tag in parent:
        way, at = [], tag
        while at in parent and at not in way:
            way.append(at)
            at = parent[at]
        r = got[tag]
        if at in way:
            assert r.cyclic and r.depth is None and r.ancestors is None
        else:
            assert (r.cyclic, r.depth, r.ancestors, r.names) == (False, len(way) - 1, way[::-1], [name[t] for t in way[::-1]])


def test_moves(spark):
    tree = spark.createDataFrame([("a", None, ""), ("b", "a", ""), ("c", "b", ""), ("d", None, ""), ("x", "y", ""), ("y", "x", "")], "tag string, parent string, name string")
    moves = [("a", "c"), ("a", "a"), ("b", "d"), ("c", None), ("zz", "a"), ("b", "zz"), ("b", "x"), ("d", "c"), ("a", "d")]
    got = {(r.tag, r.new_parent): r.verdict for r in T.checked_moves(tree, spark.createDataFrame(moves, "tag string, new_parent string"), 3).collect()}
    assert got == {("a", "c"): "cycle", ("a", "a"): "cycle", ("b", "d"): "ok", ("c", None): "ok", ("zz", "a"): "missing", ("b", "zz"): "missing", ("b", "x"): "missing", ("d", "c"): "too deep", ("a", "d"): "too deep"}


def test_empty(spark):
    assert T.ancestry(spark.createDataFrame([], "tag string, parent string, name string")).count() == 0
