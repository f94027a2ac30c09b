import random

from pyspark.sql import functions as F

from spindrel.operators import graph, intervals, similarity, traversal
from spindrel.operators.components import connected_components
from spindrel.operators.intervals import IntervalMap

EDGES = [("A", "B", "parent_child"), ("A", "C", "parent_child"), ("B", "D", "sibling"), ("C", "E", "sibling"), ("D", "E", "connects"), ("E", "F", "parent_child"), ("E", "G", "parent_child")]


def frames(spark):
    return spark.createDataFrame([(x,) for x in "ABCDEFG"], "id string"), spark.createDataFrame(EDGES, "source string, target string, type string")


def test_interval_map_equals_brute_force():
    rng = random.Random(1)
    for _ in range(50):
        m, points = IntervalMap(), set()
        for _ in range(30):
            a = rng.randrange(60)
            b = a + rng.randrange(-1, 6)
            m.insert(a, b)
            points |= set(range(a, b))
        assert {p for s, e in zip(m.starts, m.ends) for p in range(s, e)} == points
        assert all(e < s for e, s in zip(m.ends, m.starts[1:]))


def test_gaps_and_periods_with_hot_key_nulls_and_empty(spark):
    rng = random.Random(2)
    rows = [("hot", a := rng.randrange(0, 5000), a + rng.randrange(-2, 9)) for _ in range(1500)] + [("x", 10, None), (None, 1, 2), ("x", None, 5), ("x", 1, 3), ("x", 3, 4)]
    df = spark.createDataFrame(rows, "k string, s int, e int").withColumn("extra", F.lit(1))
    ts = lambda c: F.timestamp_seconds(F.col(c))
    want = {}
    for k in ("hot", "x"):
        m = IntervalMap()
        for kk, s, e in rows:
            if kk == k and s is not None and (e is None or e > s):
                m.insert(s, 10**9 if e is None else e)
        want[k] = m
    for hot in (50, 100_000):
        got = {(r["k"], r["gap_from"] // 10**6, r["gap_until"] // 10**6) for r in intervals.gaps(df, ["k"], ts("s"), ts("e"), hot=hot).collect()}
        assert got == {(k, a, b) for k, m in want.items() for a, b in m.gaps()}
        per = {(r["k"], r["period_from"] // 10**6) for r in intervals.periods(df, ["k"], ts("s"), ts("e"), hot=hot).collect()}
        assert per == {(k, s) for k, m in want.items() for s in m.starts}
    assert intervals.gaps(df.limit(0), ["k"], ts("s"), ts("e")).count() == 0


def test_bfs_paths_and_shortest(spark):
    nodes, edges = frames(spark)
    got = {r["id"]: (r["depth"], r["path"]) for r in traversal.bfs(nodes, edges, ["A"], 4).collect()}
    assert got["E"] == (2, "A>C>E") and got["G"][0] == 3 and len(got) == 7
    assert traversal.shortest_path(edges, "A", "G").first()[0] == 3
    assert traversal.shortest_path(edges, "A", "nowhere").count() == 0
    assert [r["path"] for r in traversal.simple_paths(edges, "A", "E", 5).orderBy("hops").collect()] == ["A>C>E", "A>B>D>E"]


def test_components_equal_union_find(spark):
    rng = random.Random(3)
    pairs = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 340)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(pairs, "a int, b int")).collect()}
    assert got == {x: find(x) for x in root}


def test_metrics_and_removal(spark):
    nodes, edges = frames(spark)
    assert round(graph.metrics(nodes, edges).first()["density"], 6) == round(7 / 42, 6)
    left = graph.remove_nodes(nodes, edges, spark.createDataFrame([("E",)], "id string"))
    assert left[0].count() == 6 and left[1].count() == 3


def test_similarities(spark):
    df = spark.createDataFrame([("martha", "marhta"), ("abcd", "axyz"), ("", "a"), (None, "a")], "a string, b string")
    got = [r[0] for r in df.select(F.round(similarity.jaro_winkler("a", "b"), 6)).collect()]
    assert got == [0.961111, 0.55, 0.0, None]
    words = spark.createDataFrame([("Pfister",), ("Tymczak",), ("Ashcraft",)], "a string")
    assert [r[0] for r in words.select(similarity.sound_code(F.col("a"))).collect()] == ["P123", "T520", "A261"]
