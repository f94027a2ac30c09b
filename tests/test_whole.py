"""Joins by blocks give every pair that meets the threshold."""

import random

from pyspark.sql import functions as F

from spindrel.operators import linking, resolution, similarity


def _names() -> list[str]:
    r = random.Random(5)
    part = lambda: "".join(r.choice("aeo") if i % 2 else r.choice("bdkl") for i in range(r.randint(2, 7)))
    names = [" ".join(["project"] * r.randint(0, 1) + [part() for _ in range(r.randint(1, 3))]) for _ in range(250)]
    return sorted({*names, *(n[:k] + "x" + n[k + 1 :] for n in names for k in [r.randrange(len(n))]), *("y" + n for n in names[::3]), "ann", "ann lee", "xy-long name", "zy-long name"})


def test_close_by_edits_finds_all(spark):
    names = _names()
    df = spark.createDataFrame([(n,) for n in names], "n string")
    both = df.select(F.col("n").alias("a")).crossJoin(df.select(F.col("n").alias("b"))).where("a < b")
    for least in (0.8, 0.6):
        want = both.where(similarity.levenshtein_similarity(F.col("a"), F.col("b")) >= least)
        got = [(r.a, r.b) for r in similarity.close_by_edits(df, least).collect()]
        assert sorted(got) == sorted((r.a, r.b) for r in want.collect())
        assert ("xy-long name", "zy-long name") in got  # other first letters


def test_close_by_words_finds_all(spark):
    names = _names()
    df = spark.createDataFrame([(n,) for n in names], "n string")
    score = lambda x, y: len(x & y) / len(x | y)
    ws = {n: set(n.split()) for n in names}
    want = {(a, b): score(ws[a], ws[b]) for a in names for b in names if a < b and score(ws[a], ws[b]) > 0.3}
    got = [((r.a, r.b), r.score) for r in similarity.close_by_words(df, 0.3).collect()]
    assert len(got) == len(want) and dict(got) == want and ("ann", "ann lee") in want  # short, and of other length


def test_many_jaro_winklers_equal_single_ones():
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcé ") for _ in range(r.randint(0, 12)))
    a, b = [word() for _ in range(2000)], [word() for _ in range(2000)]
    assert similarity.winklers(a, b).tolist() == [similarity.winkler(x, y) for x, y in zip(a, b, strict=True)]


def _linked(spark):
    e = spark.createDataFrame(
        [("e1", "person", "Ann Lee", {"name": "Ann Lee", "status": "on call"}), ("e2", "person", "nn Le", None), ("e3", "project", "Brick", {}), ("e4", "skill", "*", None), ("e5", None, "very quick review", None), ("e6", "event", "Fair", {"status": ""}), ("e7", "person", " ", {"status": ""})],
        "id string, type string, name string, properties map<string,string>",
    )
    c = spark.createDataFrame(
        [("c1", "Joann Leeds met them; she was on call", "sentence"), ("c2", "Bricks!", None), ("c3", "quick review", None), ("c4", "* when", "sentence"), ("c5", "ann  lee", None), ("c6", " ", None), ("c7", "they say nothing on  calls", None), ("c8", "very quick reviews", None)],
        "id string, text string, kind string",
    )
    return e, c


def test_links_by_parts_of_words_short_texts_and_properties(spark):
    e, c = _linked(spark)
    got = {(r.entity, r.chunk) for r in linking.mentions(e, c).collect()}
    assert got == {("e1", "c1"), ("e1", "c5"), ("e2", "c1"), ("e2", "c5"), ("e3", "c2"), ("e4", "c4"), ("e5", "c8")}
    rel = spark.createDataFrame([("r", "e1", "e2", "knows")], "id string, source string, target string, type string")
    assert [(r.relationship, r.chunk) for r in linking.evidence(rel, e, c).collect()] == [("r", "c1")]


def test_grounding_equals_all_pairs(spark):
    e, c = _linked(spark)
    every = {(r.entity, r.chunk): round(r.score, 9) for r in linking.grounding(e, c, 0.0).collect()}
    assert len(every) == 6 * 7
    for least in (0.3, 0.45, 0.5, 0.6):
        got = linking.grounding(e, c, least).collect()
        assert {(r.entity, r.chunk): round(r.score, 9) for r in got} == {k: v for k, v in every.items() if v >= least} and len(got) == len({(r.entity, r.chunk) for r in got})
    assert ("e6", "c4") in {k for k, v in every.items() if v >= 0.5}  # no word in common


def test_resolution_by_rare_words_loses_none(spark):
    names = [n for n in _names() if n.startswith("project") or len(n) > 9]
    e = spark.createDataFrame([(f"i{k:04}", "project" if k % 3 else None, n, {}, None) for k, n in enumerate(names + [n.title() + " ab" for n in names])], "id string, type string, name string, properties map<string,string>, embedding array<double>")
    every = {(r.id, r.match) for r in resolution.candidates(e, e).collect() if r.score >= 0.8}
    blocks = resolution._rarest(e, e, "a", 0.6).count()
    assert {(r.id, r.match) for r in resolution.candidates(e, e, 0.8).collect()} == every and every
    assert blocks < resolution._blocks(e, "a").count()  # fewer blocks, so fewer pairs
