import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from spindrel.functions import errors
from spindrel.operators import extraction, fusion, groups, hierarchy, linking, patterns, ranking, resolution, retention, sequences, similarity, temporal, traversal, vectors

EDGES = [("A", "B", "parent_child"), ("A", "C", "parent_child"), ("B", "D", "sibling"), ("C", "E", "sibling"), ("D", "E", "connects"), ("E", "F", "parent_child"), ("E", "G", "parent_child")]
ENTITY = "id string, type string, name string, properties map<string,string>, embedding array<double>"


def graph(spark):
    return spark.createDataFrame([(x,) for x in "ABCDEFG"], "id string"), spark.createDataFrame([(*e, i) for i, e in enumerate(EDGES)], "source string, target string, type string, ord int")


GOLDEN = [
    (("A", 3, 10), {}, "ABCDEFG", (7, 7, 3)), (("A", 1, 10), {}, "ABCDE", (3, 4, 1)), (("A", 0, 10), {}, "ABC", (1, 2, 0)), (("A", 10, 3), {}, "ABC", (1, 2, 0)),
    (("E", 2, 10), {"direction": "in"}, "ECDAB", (5, 5, 2)), (("E", 1, 10), {"direction": "both"}, "EFGCDAB", (5, 10, 1)), (("A", 3, 10), {"types": ["parent_child"]}, "ABC", (3, 2, 1)),
    (("A", 2, 10), {"node_filter": F.col}, "ACEFG", (3, 5, 2)), (("A", 2, 10), {"include_start": False}, "BCDEFG", (5, 7, 2)), (("A", 3, 10), {"way": "depth"}, "ACBDEGF", (5, 7, 3)),
]


@pytest.mark.parametrize("args, how, order, counts", GOLDEN)
def test_ordered_traversal(spark, args, how, order, counts):
    how = {k: F.col("id") != "B" if k == "node_filter" else v for k, v in how.items()}
    rows = traversal.ordered(*graph(spark), *args, **how).orderBy("pos").collect()
    assert "".join(r["id"] for r in rows) == order and (rows[0]["visited"], rows[0]["edges"], rows[0]["depth"]) == counts


def test_traversal_unknown_start_paths_and_filters(spark):
    nodes, edges = graph(spark)
    with pytest.raises(ValueError):
        traversal.ordered(nodes, edges, "nowhere", 2)
    assert traversal.ego(nodes, edges, "nowhere").count() == 0
    assert traversal.ordered(nodes, edges, "A", 3, 0, include_start=False).count() == 0
    assert {r["path"] for r in traversal.ordered(nodes, edges, "A", 3, way="depth").where("id = 'E'").collect()} == {"A>B>D>E"}
    assert "".join(r["id"] for r in traversal.ordered(nodes, edges, "A", 3, way="depth", edge_filter=F.col("type") == "parent_child").orderBy("pos").collect()) == "ACB"
    assert traversal.shortest_path(edges, "A", "G").first() == (3, "A>C>E>G") and traversal.shortest_path(edges, "A", "A").first()[0] == 0
    assert traversal.ego(nodes, edges, "A", 1).count() == 3


def test_similarity_goldens(spark):
    rows = [("kitten", "sitting"), ("martha", "marhta"), ("abcd", "axyz"), ("john smith", "jon smith"), ("techcorp", "tech corp")]
    df = spark.createDataFrame(rows, "a string, b string").withColumn("jw", similarity.jaro_winkler("a", "b"))
    a, b = F.col("a"), F.col("b")
    fuzzy = (similarity.levenshtein_similarity(a, b) + F.col("jw")) / 2
    sound = (similarity.sound_code(a) == similarity.sound_code(b)).cast("double")
    got = [round(r[0], 6) for r in df.select(similarity.composite(fuzzy, similarity.jaccard(a, b), sound, F.lit(0.0))).collect()]
    assert got == [0.329365, 0.556944, 0.2, 0.701667, 0.616667]


def test_relevance_goldens(spark):
    rows = [("a", "protocol", {"name": "protocol"}), ("b", "the protocol", {"name": "the protocol"}), ("c", "proto", {"name": "proto"}), ("d", "other", {"name": "other"}), ("e", "", {}), ("f", None, None)]
    df = spark.createDataFrame(rows, "id string, name string, properties map<string,string>").withColumn("score2", F.lit(1))
    got = {r["id"]: round(r["s"], 6) for r in df.select("id", ranking.relevance(F.col("name"), F.col("properties"), "protocol").alias("s")).collect()}
    assert got == {"a": 1.0, "b": 0.9, "c": 0.7, "d": 0.0, "e": 0.0, "f": 0.0}
    assert ranking.names_in("Who knows Alice") == ["Alice"] and ranking.names_in("what now") == ["what now"]


def test_ranking_branches_and_order(spark):
    one = spark.createDataFrame([("x", 0.8), ("y", 0.0)], "id string, score double")
    two = spark.createDataFrame([("x", 0.1), ("z", 0.3)], "id string, score double")
    assert {tuple(r) for r in ranking.first_hit([one, two]).collect()} == {("x", 0.8), ("y", 0.0), ("z", 0.3)}
    got = ranking.combine({"chunk": one, "link": two.limit(0)}, limit=5).collect()
    assert [(r["id"], r["score"]) for r in got] == [("x", 0.8), ("y", 0.5)]
    acc = spark.createDataFrame([("y", dt.datetime(2025, 1, 1))] * 6, "id string, at timestamp")
    boosted = {r["id"]: round(r["score"], 3) for r in ranking.recent_first(two.union(spark.createDataFrame([("y", 0.5)], two.schema)), acc, kind="entity").collect()}
    assert boosted == {"x": 0.1, "z": 0.3, "y": 0.725}
    with pytest.raises(ValueError):
        ranking.multi_index(one, [], "some")


def entities(spark):
    rows = [("p1", "person", "Alice Moor", {"email": "a@x.org"}, None), ("p2", "person", "alice moor", {}, None), ("p3", "person", "Alise Moor", None, None), ("o1", "organization", "Moor Labs", {"email": "a@x.org"}, None), ("n", "person", None, None, None), ("b", "person", " ", {}, None)]
    return spark.createDataFrame(rows, ENTITY).withColumn("match", F.lit("clash"))


def test_resolution(spark):
    e = entities(spark)
    assert {tuple(r) for r in resolution.exact(e, e).collect()} == {("p1", "p2"), ("p2", "p1")}
    got = {r["id"]: (r["match"], r["how"]) for r in resolution.resolve(e.drop("match"), e.drop("match"), 0.65).collect()}
    assert got["p1"] == ("p2", "exact") and got["p3"][1] == "similar" and got["o1"] == (None, None) and got["n"] == (None, None)
    assert resolution.resolve(e.drop("match").limit(0), e.drop("match")).count() == 0
    merged = spark.range(1).select(resolution.merge_properties(F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2")), F.create_map(F.lit("b"), F.lit("3")), F.lit("t"), "me").alias("m")).first()["m"]
    assert merged == {"a": "1", "b": "3", "lastUpdated": "t", "updatedBy": "me"}


def test_linking_with_nulls_and_empty(spark):
    e = entities(spark).drop("match")
    chunks = [("c1", "The Alice Moor is here, they said. " + "x " * 120, "sentence"), ("c2", "Nobody.", "sentence"), ("c3", None, None), ("c4", "", "sentence"), ("c5", "by moor labs and ALICE MOOR", None)]
    c = spark.createDataFrame(chunks, "id string, text string, kind string").withColumn("name", F.lit(1))
    got = {(r["entity"], r["chunk"]): r["mention"] for r in linking.mentions(e, c).collect()}
    assert got[("p1", "c1")] == "definite_mention" and got[("o1", "c5")] == "object_mention" and ("p3", "c1") not in got and not {k for k in got if k[1] in ("c2", "c3", "c4")}
    rel = spark.createDataFrame([("r", "p1", "o1", "works_at"), ("s", None, "o1", "knows")], "id string, source string, target string, type string")
    assert [tuple(r) for r in linking.evidence(rel, e, c).collect()] == [("r", "c5", 0.5)]
    assert linking.mentions(e.limit(0), c).count() == 0 and linking.links(e, c.limit(0), rel).count() == 0
    assert spark.range(1).select(linking.time_alignment(F.lit("Meeting on 2025-01-02, tomorrow"), F.lit(True))).first()[0] == pytest.approx(1.0)


def test_temporal_rules(spark):
    t = lambda s: dt.datetime(2025, 1, 1) + dt.timedelta(seconds=s)
    rows = [("1", "a", "b", "works_at", t(10), None), ("2", "a", "b", "unemployed", t(20), None), ("3", "a", "b", "knows", t(15), t(17))]
    e = spark.createDataFrame(rows, "id string, source string, target string, type string, valid_from timestamp, valid_until timestamp")
    got = {r["id"]: r["valid_until"] for r in temporal.superseded(e, temporal.conflict_class(F.col("type")), [F.col("valid_from")]).collect()}
    assert got == {"1": t(20), "2": None, "3": t(17)}
    by = {r["id"]: r["valid_until"] for r in temporal.superseded_by_change(e, [F.col("valid_from")]).collect()}
    assert by == {"1": t(15), "2": None, "3": t(17)}
    kinds = spark.createDataFrame([("works at",), ("works_at",), ("created",), ("knows",), (None,)], "n string").select(temporal.temporal_type(F.col("n"))).collect()
    assert [r[0] for r in kinds] == ["state", "state", "event", "fact", "fact"]
    ended = temporal.invalidate(e, spark.createDataFrame([("1", t(12), "x"), ("3", t(30), "late")], "id string, at timestamp, reason string"))
    assert {r["id"]: (r["valid_until"], r["reason"]) for r in ended.collect()} == {"1": (t(12), "x"), "2": (None, None), "3": (t(17), None)}
    assert {r["id"] for r in temporal.valid_at(temporal.superseded(e, F.lower("type"), [F.col("valid_from")]), F.lit(t(16))).collect()} == {"1", "3"}


def test_sequences(spark):
    t = lambda s: dt.datetime(2025, 1, 1) + dt.timedelta(seconds=s)
    ev = [(1, "k1", t(0), "click"), (2, "k1", t(10), "view"), (3, "k1", t(50), "purchase"), (4, "k2", t(0), "click"), (5, "k2", t(90), "purchase"), (6, "k3", t(0), "click"), (7, "k3", t(50), "click"), (8, "k3", t(100), "purchase"), (9, None, t(0), "click")]
    df = spark.createDataFrame(ev, "event_id int, k string, ts timestamp, kind string")
    assert [r[0] for r in temporal.has_sequence(df, "k", "ts", "kind", ["click", "purchase"], 60_000).collect()] == ["k1"]
    log = [("s", t(0), "start", "trip"), ("s", t(1), "add", "a"), ("s", t(5), "complete", ""), ("s", t(9), "add", "late"), ("u", t(1), "add", "none")]
    seqs, refused = sequences.replay(spark.createDataFrame(log, "seq string, at timestamp, what string, type string"))
    assert [(r["seq"], r["status"], r["events"]) for r in seqs.collect()] == [("s", "completed", 1)] and {(r["seq"], r["type"]) for r in refused.collect()} == {("s", "late"), ("u", "none")}
    assert sequences.durations(seqs).first()["mean_ms"] == 5000
    c = spark.createDataFrame([("a", []), ("b", ["a", "zz"])], "id string, caused_by array<string>")
    assert [tuple(r) for r in sequences.causes(c).collect()] == [("a", "b")]


def test_extraction(spark):
    text = "Alice works at TechCorp. Bob Stone leads Marketing Group! Carol's Project was late. Dave knows Mary. He knows Mary."
    df = spark.createDataFrame([("t", text), ("n", None), ("e", " "), ("l", "word " * 20_000)], "id string, text string").withColumn("name", F.lit(0))
    deps = {(r["head"], r["relation"], r["dependent"]): r["confidence"] for r in extraction.dependencies(df).collect()}
    assert deps[("Alice", "works_at", "TechCorp")] == 0.95 and deps[("Bob Stone", "leads", "Marketing Group")] == 0.95 and deps[("Dave", "knows", "Mary")] == 0.85 and deps[("Carol", "owns", "Project")] == 0.9
    assert not any(h == "He" for h, *_ in deps)
    ents = {r["name"]: r["type"] for r in extraction.entities(df).collect()}
    assert ents["TechCorp"] == "person" or ents["TechCorp"] == "organization"
    rel = {(r["type"], r["confidence"]) for r in extraction.relationships(df).collect()}
    assert ("knows", 0.85) in rel and any(t == "works_at" for t, _ in rel)
    kinds = spark.createDataFrame([("TechCorp",), ("Dr Who",), ("Ann Lee",), ("Oak Street",), ("machine learning",), ("IBM",)], "n string").select(extraction.entity_type(F.col("n"), F.lit("knows"), F.lit(True))).collect()
    assert [r[0] for r in kinds] == ["organization", "person", "person", "person", "concept", "organization"]
    ok = spark.createDataFrame([("the car",), ("a b c d e",), ("12",), ("Ann",)], "n string").select(extraction.valid_entity(F.col("n"))).collect()
    assert [r[0] for r in ok] == [False, False, False, True]


def test_answers_of_models(spark):
    assert extraction.parse_answer("Sure: ```json\n{\"entities\": []}\n``` done") == {"entities": []}
    assert extraction.parse_answer("x {entities: [{'name': 'Ann', 'type': 'person',}]} y") == {"entities": [{"name": "Ann", "type": "person"}]}
    assert extraction.parse_answer("nothing") is None and extraction.parse_answer(None) is None
    df = spark.createDataFrame([("1", "Ann"), ("2", None)], "id string, text string")
    good = extraction.extract_with(df, lambda ts: [json.dumps({"entities": [{"name": t, "type": "Person"}, {"name": "x", "type": "y", "confidence": 7}]}) for t in ts]).collect()
    assert [tuple(r) for r in good] == [("1", "Ann", "person", 1.0)]

    def broken(ts):
        raise RuntimeError("away")

    assert extraction.extract_with(df, broken).count() == 0


def test_patterns():
    p = patterns.Pattern("p", {"a": "person", "b": None}, [("a", "b", "knows", "out")])
    q = patterns.Pattern("q", {"x": "org", "y": "person"}, [("x", "y", "knows", "in")])
    r = patterns.Pattern("r", {"x": "person", "y": "person"}, [("y", "x", "knows", "out"), ("x", "y", "knows", "out")])
    assert patterns.isomorphic(p, q) and not patterns.isomorphic(p, r) and patterns.pairs_of([p, q, r]) == [("p", "q")]


def test_vectors_and_fusion(spark):
    df = spark.createDataFrame([(1, [3.0, 4.0], 1.0), (2, [0.0, 0.0], 3.0), (3, None, 1.0), (4, [1.0], 1.0)], "id int, v array<double>, w double").withColumn("group", F.lit("clash"))
    assert [r["v"] for r in df.where("id < 3").select(vectors.normalize(F.col("v")).alias("v")).orderBy("v").collect()] == [[0.0, 0.0], [0.6, 0.8]]
    assert {r["issue"]: r["n"] for r in vectors.quality(df, "v", 2).collect()} == {"good": 1, "zero": 1, "missing": 1, "other length": 1}
    assert vectors.weighted_centroids(df, "group", "v", "w", 2).first()["vector"] == pytest.approx([0.6, 0.8])
    with pytest.raises(Exception):
        df.where("id = 4").select(vectors.cosine_strict(F.col("v"), F.array(F.lit(1.0), F.lit(2.0)))).collect()
    assert vectors.combine([[1.0, -2.0], [3.0, -4.0]], "max") == [3.0, -2.0] and vectors.combine([[1.0], [3.0]], weights=[1, 3]) == [2.5]
    for bad in ({"how": "concat"}, {}):
        with pytest.raises(ValueError):
            vectors.combine([[1.0], [1.0, 2.0]], **bad)
    one = spark.range(1).select(F.array(F.lit(1.0), F.lit(0.0)).alias("a"), F.array(F.lit(0.0), F.lit(1.0)).alias("b"))
    r = one.select(fusion.attention(F.array("a", "b"), 2).alias("x"), fusion.weighted(F.col("a"), F.col("b")).alias("w"), fusion.crossed(F.array("a"), F.array("b"), 2).alias("c"), fusion.attention(F.array().cast("array<array<double>>"), 2).alias("none")).first()
    assert r["x"] == pytest.approx([0.5, 0.5]) and r["w"] == pytest.approx([0.919145, 0.393919], abs=1e-5) and r["none"] is None
    assert r["c"] == pytest.approx([0.393919, 0.919145], abs=1e-5)


def test_groups(spark):
    rows = [(f"{c}{i}", [1.0 + i * 0.01, 0.0] if c == "x" else [0.0, 1.0 + i * 0.01]) for c in "xy" for i in range(5)] + [("n", None), ("z", [0.0, 0.0])]
    df = spark.createDataFrame(rows, "id string, embedding array<double>")
    for got in (groups.kmeans(df, 2, dim=2).collect(), groups.agglomerate(df, 2, dim=2, threshold=0.5).collect(), groups.agglomerate(df, 2, dim=2, threshold=0.5, start=4).collect()):
        by = {}
        for r in got:
            by.setdefault(r["cluster"], set()).add(r["id"][0])
        assert sorted(map(tuple, by.values())) == [("x",), ("y",)]
    assert groups.kmeans(df.limit(0), 2, dim=2).count() == 0 and groups.agglomerate(df.limit(0), 2, dim=2).count() == 0


def test_hierarchy_and_retention(spark):
    m = spark.createDataFrame([("g", x) for x in "abc"] + [("h", "d")], "group string, id string")
    rel = spark.createDataFrame([("a", "b", "contains"), ("a", "c", "manages"), ("b", "a", "knows")], "source string, target string, type string")
    got = {r["group"]: (r["root"], r["pairs"], round(r["confidence"], 3)) for r in hierarchy.hierarchies(m, rel).collect()}
    assert got == {"g": ("a", 2, 1.0), "h": ("d", 0, 1.0)}
    items = spark.createDataFrame([(f"i{i}", dt.datetime(2025, 1, 1 + i)) for i in range(6)], "id string, created_at timestamp")
    acc = spark.createDataFrame([("i0", dt.datetime(2025, 3, 1)), ("i1", dt.datetime(2025, 2, 1))], "id string, at timestamp")
    assert {r["id"] for r in retention.evicted(items, acc, 5, spare=1).collect()} == {"i2", "i3"} and retention.evicted(items, acc, 9).count() == 0


def test_errors():
    calls, log = [], errors.Errors(many=1)

    def work():
        calls.append(1)
        if len(calls) < 3:
            raise errors.EngineError("storage", "away")
        return 7

    with pytest.raises(errors.EngineError):
        errors.attempt(work, wait=0, errors=log)
    assert len(calls) == 1

    def flaky():
        calls.append(1)
        if len(calls) < 4:
            raise OSError("away")
        return 7

    assert errors.attempt(flaky, wait=0, errors=log) == 7 and errors.attempt(lambda: 1 / 0, tries=1, fallback=lambda: 0) == 0
