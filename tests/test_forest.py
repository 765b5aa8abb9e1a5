"""Forests as intervals, circles, points in intervals, and reachability with an index."""

import random

import pytest
from pyspark.sql import functions as F

from stewardspark.operators import forest as f
from stewardspark.operators import lineage as g


def above(links):
    """(node, ancestor, distance) by following pointers."""
    up, out = dict(links), set()
    for node in up:
        at, distance, seen = up[node], 1, {node}
        while at is not None and at not in seen:
            out.add((node, at, distance))
            seen.add(at)
            at, distance = up.get(at), distance + 1
    return out


def links_of(spark, links):
    return spark.createDataFrame(links, "node int, parent int")


def shapes():
    draw = random.Random(2)
    tree = [(i, draw.randrange(max(0, i - 8), i)) for i in range(1, 60)]
    return {
        "tree": tree + [(0, None)],
        "chain": [(i, i - 1) for i in range(1, 70)],
        "star": [(i, 0) for i in range(1, 50)],
        "circles": [(1, 2), (2, 3), (3, 1), (4, 1), (5, 4), (6, 5), (7, 8), (8, 7), (9, 3), (20, 21), (22, 22), (23, None)],
        "one circle": [(i, (i + 1) % 33) for i in range(33)],
        "random pointers": [(i, draw.randrange(40)) for i in range(40)],
    }


def apart(parts):
    """All parts as one, with numbers of their own."""
    return [tuple(None if x is None else x + 1000 * k for x in pair) for k, part in enumerate(parts) for pair in part]


def test_ancestors_by_intervals(spark):
    links = apart(shapes().values())
    tree = f.forest(links_of(spark, links))
    plain = [(n, p) for n, p in links if n != p]
    assert {tuple(r) for r in f.ancestors(tree).collect()} == above(plain)
    rows = {r["node"]: r for r in tree.collect()}
    assert set(rows) == {x for pair in links for x in pair if x is not None}
    for r in rows.values():
        below = [s for s in rows.values() if s["root"] == r["root"] and r["pre"] <= s["pre"] < r["pre"] + r["size"]]
        assert len(below) == r["size"]
        assert r["parent"] is None or rows[r["parent"]]["depth"] == r["depth"] - 1
    rings = {}
    for r in f.circles(tree).collect():
        rings.setdefault(r["root"], set()).add(r["node"])
    up = dict(plain)
    assert all(min(ring) == root and {up[n] for n in ring} == ring for root, ring in rings.items())


def test_many_children_are_numbered_in_buckets(spark, monkeypatch):
    monkeypatch.setattr(f, "SIBLINGS", 7)
    tree = f.forest(links_of(spark, [(i, i // 40 if i > 40 else 0) for i in range(1, 200)]))
    assert sorted(r["pre"] for r in tree.collect()) == list(range(200))


def test_odd_links(spark):
    assert f.forest(links_of(spark, [])).collect() == []
    assert f.ancestors(f.forest(links_of(spark, []))).collect() == []
    repeated = f.forest(links_of(spark, [(1, 2), (1, 2), (None, 3), (4, None)]))
    assert {r["node"] for r in repeated.collect()} == {1, 2, 3, 4}
    with pytest.raises(Exception, match="more than one parent"):
        f.forest(links_of(spark, [(1, 2), (1, 3)]))


def test_points_in_intervals(spark):
    draw = random.Random(6)
    points = [(k, draw.randrange(100)) for k in range(60)]
    spans = [(k, *sorted((draw.randrange(100), draw.randrange(101)))) for k in range(40)]
    left = spark.createDataFrame([("a", *p) for p in points], "key string, p int, at bigint")
    right = spark.createDataFrame([("a", *s) for s in spans] + [("b", 99, 0, 100)], "key string, s int, low bigint, high bigint")
    found = sorted((r["p"], r["s"]) for r in f.covered(left, "at", right, "low", "high", ["key"]).collect())
    assert found == sorted((p, s) for p, at in points for s, low, high in spans if low <= at < high)
    few = right.where("s < 4")
    alone = {r["p"] for r in f.covered(left, "at", few, "low", "high", ["key"], "left_anti").collect()}
    assert alone == {p for p, at in points if not any(low <= at < high for s, low, high in spans if s < 4)}


def reach(edges):
    out = {}
    for seed in {a for a, _ in edges}:
        seen, todo = set(), [seed]
        while todo:
            for a, b in edges:
                if a == todo[0] and b not in seen:
                    seen.add(b)
                    todo.append(b)
            todo.pop(0)
        out[seed] = seen - {seed}
    return {(s, n) for s, ns in out.items() for n in ns}


GRAPHS = {
    "layers": [(a, b) for a in range(12) for b in range(a + 1, min(12, a + 4))],
    "circle with tails": [(0, 1), (1, 2), (2, 0), (2, 3), (3, 4), (5, 0), (4, 6), (6, 4)],
    "chain": [(i, i + 1) for i in range(40)],
    "random": [(random.Random(s).randrange(25), random.Random(s + 99).randrange(25)) for s in range(45)],
}


@pytest.mark.parametrize("direction", ["downstream", "upstream"])
def test_reached_from_many_seeds(spark, direction):
    pairs = [(a, b) for a, b in apart(GRAPHS.values()) if a != b]
    edges = spark.createDataFrame(
        [(a, b, True) for a, b in pairs] + [(0, 24, False), (None, 1, True), (3, 3, True)],
        "src_node_id int, tgt_node_id int, active_flag boolean",
    )
    walk = pairs if direction == "downstream" else [(b, a) for a, b in pairs]
    seeds = spark.createDataFrame([(a,) for a, _ in walk] + [(77,), (None,)], "node_id int")
    found = g.reached_from(g.reach_index(edges, direction), seeds)
    assert {tuple(r) for r in found.collect()} == reach(walk)


def test_a_long_path_takes_few_rounds(spark, monkeypatch):
    """300 hops and two detours: the walk follows edges outside the forest only."""
    edges = spark.createDataFrame(
        [(i, i + 1, True) for i in range(300)] + [(10, 900, True), (900, 200, True), (5, 250, True)],
        "src_node_id int, tgt_node_id int, active_flag boolean",
    )
    index = g.reach_index(edges)
    kept = []
    keep = f.Steps.keep
    monkeypatch.setattr(f.Steps, "keep", lambda self, df: kept.append(1) or keep(self, df))
    seeds = spark.createDataFrame([(0,), (290,)], "node_id int")
    found = g.reached_from(index, seeds).groupBy("seed").agg(F.count("*").alias("n")).collect()
    assert {r["seed"]: r["n"] for r in found} == {0: 301, 290: 10}
    assert len(kept) <= 7


@pytest.mark.parametrize("how", ["inner", "left_anti"])
def test_cut_intervals_are_not_broadcast(spark, how):
    """A few intervals before the cut may be very many blocks after it."""
    points = spark.range(40).select(F.lit("r").alias("root"), F.col("id").alias("at"))
    spans = spark.range(3).select(F.lit("r").alias("root"), (F.col("id") * 10).alias("low"), (F.col("id") * 10 + 7).alias("high"))
    found = f.covered(points, "at", spans, "low", "high", ["root"], how)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    inside = {at for at in range(40) if at < 30 and at % 10 < 7}
    assert {r["at"] for r in found.collect()} == (inside if how == "inner" else set(range(40)) - inside)


def test_rows_between_numbers(spark, monkeypatch):
    """Blocks and stretches are crossed; every row of a span comes once."""
    monkeypatch.setattr(f, "BLOCK", 2)
    monkeypatch.setattr(f, "STRETCH", 3)
    draw = random.Random(8)
    rows = spark.range(60).select(F.col("id").alias("number"), (F.col("id") * 7).alias("x")).repartition(5)
    spans = [(k, *sorted((draw.randrange(61), draw.randrange(61)))) for k in range(40)]
    found = f.between(spark.createDataFrame(spans, "s int, low bigint, high bigint"), "low", "high", f.blocks(rows, "number"))
    assert sorted((r["s"], r["_row"]["x"]) for r in found.collect()) == [(k, 7 * n) for k, a, b in sorted(spans) for n in range(a, b)]
    amounts = [(draw.randrange(40), draw.randrange(2)) for _ in range(90)]
    summed = f.running(spark.createDataFrame(amounts, "at bigint, n int"), "at", "n", "before").orderBy("before", "at", "n").collect()
    total = 0
    assert sorted((r["at"], r["n"]) for r in summed) == sorted(amounts)
    for r in sorted(summed, key=lambda r: (r["at"], r["n"], r["before"])):
        assert r["before"] == total
        total += r["n"]


@pytest.mark.parametrize("length, seeds, most", [(32, range(33), 11), (5, [0], 15)])
def test_jumps_in_a_row(spark, monkeypatch, length, seeds, most):
    """Each edge of a path lies outside the forest; among seeds a round doubles how far the walk has come."""
    edges = [(i, i + 1, True) for i in range(length)] + [(-i - 1, i + 1, True) for i in range(length)]
    index = g.reach_index(spark.createDataFrame(edges, "src_node_id int, tgt_node_id int, active_flag boolean"))
    kept = []
    keep = f.Steps.keep
    monkeypatch.setattr(f.Steps, "keep", lambda self, df: kept.append(1) or keep(self, df))
    found = g.reached_from(index, spark.createDataFrame([(s,) for s in seeds], "node_id int"))
    assert sorted(map(tuple, found.collect())) == [(s, n) for s in seeds for n in range(s + 1, length + 1)]
    assert len(kept) <= most
