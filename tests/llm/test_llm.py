import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spindrel.llm import bpe, clusters, language, mixing, names, nearcopies, neighbours, personal

WORDS = [f"w{i}" for i in range(400)]
TEXTS = "id string, text string, extra int"


def test_near_copies_match_brute_force(spark):
    rng = random.Random(1)
    base = [[rng.choice(WORDS) for _ in range(rng.randrange(20, 60))] for _ in range(30)]
    rows = []
    for i, words in enumerate(base):
        for j in range(4):
            w = words[:]
            for _ in range(j * 2):
                w[rng.randrange(len(w))] = rng.choice(WORDS)
            rng.shuffle(w)
            rows.append((f"{i:02d}-{j}", " ".join(w), 1))
    rows += [("n", None, 1), (None, "a b c d e f g h i j", 1), ("e", "", 1), ("s", "too short", 1), rows[0], ("copy", rows[0][1], 1), ("long", "word " * 50_000, 1)]
    want = {(min(a[0], b[0]), max(a[0], b[0])) for a in rows for b in rows if a[0] and b[0] and a[1] and b[1] and a[0] != b[0] and len(a[1].split()) >= 8 and len(b[1].split()) >= 8 and nearcopies.overlap(a[1], b[1]) >= 0.75}
    df = spark.createDataFrame(rows, TEXTS)
    got = {(r["id_a"], r["id_b"]) for r in nearcopies.near_copy_pairs(df).collect()}
    assert got <= want and len(got) >= 0.95 * len(want)
    assert nearcopies.near_copy_pairs(df.limit(0)).count() == 0


def test_neighbours_recall_ties_and_invalid(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((300, 64))
    x[150:] = x[:150] + 0.2 * rng.standard_normal((150, 64))
    rows = [(f"{i:03d}", [float(v) for v in r]) for i, r in enumerate(x)]
    rows += [("same", rows[0][1]), ("null", None), ("empty", []), ("zero", [0.0] * 64), ("nan", [float("nan")] * 64), ("short", [1.0]), (None, rows[1][1])]
    df = spark.createDataFrame(rows, "id string, embeddings array<float>")
    for hot in (20_000, 20):
        got = {(r["id"], r["other"]) for r in neighbours.nearest(df, 5, min_cosine=0.9, hot=hot).collect()}
        u = x / np.linalg.norm(x, axis=1, keepdims=True)
        s = u @ u.T
        want = {(f"{i:03d}", f"{j:03d}") for i, j in zip(*np.nonzero(s >= 0.9)) if i != j}
        assert len(got & want) >= 0.95 * len(want) and ("same", "000") in got
        assert not {a for a, _ in got} & {"null", "empty", "zero", "nan", "short"}


def test_neighbours_of_some_rows_match_brute_force(spark):
    rng = np.random.default_rng(6)
    x = rng.standard_normal((400, 64))
    x[200:300] = x[:100]  # equal and nearly equal vectors share their home cells
    x[300:] = x[100:200] + 0.03 * rng.standard_normal((100, 64))
    df = spark.createDataFrame([(f"{i:03d}", [float(v) for v in r], i < 200) for i, r in enumerate(x)], "id string, embeddings array<float>, ask boolean")
    s = x @ x.T / np.outer(np.linalg.norm(x, axis=1), np.linalg.norm(x, axis=1))
    np.fill_diagonal(s, -1)
    want = {(f"{i:03d}", f"{s[i].argmax():03d}") for i in range(200)}
    for hot in (20_000, 20):
        got = {(r["id"], r["other"]) for r in neighbours.nearest(df, 1, query=F.col("ask"), tables=3, probes=40, width=4.0, m=8, hot=hot).collect()}
        assert len(got & want) >= 0.99 * len(want) and {a for a, _ in got} <= {a for a, _ in want}


def test_equal_vectors_are_capped_and_equal_codes_are_not():
    rng = np.random.default_rng(3)
    x = np.repeat(rng.standard_normal((1, 64)), 220, axis=0)
    x[:200] += 1e-4 * rng.standard_normal((200, 64))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    rows = np.zeros(220, neighbours.record(64))
    rows["id"], rows["same"] = np.arange(220), neighbours.vector_hash(x)
    rows["code"] = np.rint(x / (np.abs(x).max() / 127))
    kept = neighbours._first_copies(rows, 11)
    assert set(range(200)) <= set(kept.tolist()) and len(kept) == 211


def test_bpe_equals_merges_and_round_trip(spark):
    try:
        code = bpe.encoder(bpe.vocabulary("byte_bpe_50k"))
    except OSError:
        pytest.skip("no vocabulary")
    for t in ["hello world", "antidisestablishmentarianism", "  x\n\n y", "Привет 🌍", "<|endoftext|>", "a" * 300]:
        ids = code.encode(t)
        assert code.decode(ids) == t
        assert ids == [i for p in code.split(t) for i in code.merges(p.encode())]
    df = spark.createDataFrame([(1, None), (2, ""), (3, "hi")], "doc_id long, text string")
    got = {r["doc_id"]: r["ids"] for r in bpe.token_ids(df).collect()}
    assert got[1] == [] and got[2] == [] and len(got[3]) == 1


def test_water_fill():
    e = mixing.water_fill({"a": 0.5, "b": 0.5, "z": 0.0}, {"a": 100, "b": 10, "z": 5}, {"a": 2, "b": 3, "z": 1}, 120)
    assert e == {"a": pytest.approx(0.9), "b": pytest.approx(3.0), "z": 0.0}
    assert mixing.water_fill({}, {}, {}, 0) == {}


def test_names():
    r = names.Reader({"deborah": 9, "henry": 9}, {"consulting": 9, "robotics": 9}, [("debbie", "deborah")])
    assert r.read("Lifataso, Debbie", "person") == r.read("DEBORAH  LIFATASO (she)", None) == ("person", "lifataso", ("deborah",))
    assert r.read("Hupefax Cons.", "ORG") == r.read("HupefaxConsulting", None) == ("org", "hupefax", ("consulting",))
    assert r.read("PRJ-Zivobecex", "proj") == r.read("Zivobecex (project)", None)
    assert r.read("DeborahLifataso", "person") == r.read("DEBORAHLIFATASO", "person") == r.read("Deborah Lifataso", "person")
    b = names.Reader({"robert": 9}, {"studio": 5, "systems": 9}, [("bobby", "robert")])
    assert b.read("Bob Hupefalo", "person") == b.read("Robert Hupefalo", "person") and b.read("Hupefax St.", "org") == b.read("Hupefax Studio", "org")
    assert names.placeholder("N/A") and names.placeholder(None) and names.edits("kofi", "kfoi") == 1


def test_entities_with_nulls_and_empty(spark):
    rows = [(f"{i}", "person", n) for i, n in enumerate(["Deborah Lifataso", "lifataso, debbie", "Deborah Lifatsao", "Henry Lifataso", None, "  ", "unknown"])]
    df = spark.createDataFrame([*rows, rows[0]], "id string, type string, name string")
    alias = spark.createDataFrame([("Debbie", "Deborah"), ("Hank", "Henry"), (None, None)], "short_name string, given_name string")
    got = {tuple(r) for r in names.linked_pairs(names.entities(df, alias)).collect()}
    assert got == {("0", "1"), ("0", "2"), ("1", "2")}
    assert names.linked_pairs(names.entities(df.limit(0), alias.limit(0))).count() == 0


def test_entities_with_rare_given_names(spark):
    wanted = ["Zbigniew Hupefalo", "Z. Hupefalo", "Zbigneiw Hupefalo", "Zbig. Hupefalo", "hupefalo, zbi"]
    rows = [(f"{i}", "person", n) for i, n in enumerate([*wanted, "Noemi Lifataso", "Naomi Lifataso", "N. Lifataso", "Zbigniew Cozemira"])]
    df = spark.createDataFrame(rows, "id string, type string, name string")
    alias = spark.createDataFrame([("Debbie", "Deborah")], "short_name string, given_name string")
    got = {tuple(r) for r in names.linked_pairs(names.entities(df, alias)).collect()}
    assert got == {(str(a), str(b)) for a in range(5) for b in range(a + 1, 5)}


def test_linked_pairs_of_a_large_entity(spark):
    rows = [(f"{i:02d}", 1, i) for i in range(9)] + [(f"{i:02d}", 1, 9) for i in range(9, 20)] + [("x", 2, 1)]
    df = spark.createDataFrame(rows, "id string, entity long, spelling long")
    got = {tuple(r) for r in names.linked_pairs(df, expand=5).collect()}
    assert got == {(f"{a:02d}", f"{b:02d}") for a in range(10) for b in range(a + 1, 10)} | {("09", f"{b:02d}") for b in range(10, 20)}


def test_clusters(spark):
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((3, 64))
    rows = [(f"{c}-{i}", [float(v) for v in centres[c] + 0.6 * rng.standard_normal(64)], 1) for c in range(3) for i in range(60)]
    rows += [("null", None, 1), ("zero", [0.0] * 64, 1), ("short", [1.0], 1), ("nan", [float("nan")] * 64, 1), (None, rows[0][1], 1), rows[0]]
    rows += [("far", [float(v) for v in rng.standard_normal(64)], 1)]
    df = spark.createDataFrame(rows, "id string, embeddings array<float>, cluster int")
    for how in ({}, {"one_block": 8, "node_block": 8, "cell": 64, "row_block": 16}):  # the second ends with the distributed squaring
        members, found = clusters.cluster(df, **how)
        got = {r["id"]: r["cluster"] for r in members.collect()}
        assert len({got[f"{c}-0"] for c in range(3)}) == 3 and len(got) == 180
        assert all(got[f"{c}-{i}"] == got[f"{c}-0"] for c in range(3) for i in range(60))
        top = {r["cluster"]: r for r in clusters.describe(members, found, 4).collect()}
        assert all(r["size"] == 60 and len(r["members"]) == 4 and {got[m] for m in r["members"]} == {c} for c, r in top.items())
    assert clusters.cluster(df.limit(0))[0].count() == 0


def test_clusters_many_and_small(spark):
    rng = np.random.default_rng(8)
    rows = [(f"{c}-{i}", [float(v) for v in x + 0.3 * rng.standard_normal(64)]) for c, x in enumerate(rng.standard_normal((600, 64))) for i in range(4)]
    members, found = clusters.cluster(spark.createDataFrame(rows, "id string, embeddings array<float>"), least_size=3, row_edge=0.6)
    got = {r["id"]: r["cluster"] for r in members.collect()}
    assert sum(len({got.get(f"{c}-{i}", c) for i in range(4)}) == 1 for c in range(600)) >= 590 and found.count() >= 590


def test_clusters_take_rows_of_any_cell(spark, monkeypatch):
    rng = np.random.default_rng(12)
    centres = rng.standard_normal((4, 64))
    x = {f"{c}-{i}": v + 1.1 * rng.standard_normal(64) for c, v in enumerate(centres) for i in range(150)}
    df = spark.createDataFrame([(k, v.tolist()) for k, v in x.items()], "id string, embeddings array<float>")
    sizes = []
    for piece in (2048, 2):  # the second compares rows with the clusters in pieces
        monkeypatch.setattr(clusters, "PIECE", piece)
        members, found = clusters.cluster(df, cell=8)
        got = {r["id"]: (r["cluster"], r["affinity"]) for r in members.collect()}
        centre = {r["cluster"]: np.array(r["centroid"]) for r in found.collect()}
        least = {c: min(a for k, a in got.values() if k == c) for c in centre}
        for k, v in x.items():  # whoever is as much alike as a member is one
            near, c = max((float(v @ m) / np.linalg.norm(v), c) for c, m in centre.items())
            assert near < least[c] + 1e-5 or got[k][0] == c
        sizes.append(sorted(r["size"] for r in found.collect()))
    assert len(sizes[0]) == 4 and sizes[0] == sizes[1]


def test_clusters_link_all_pairs(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((400, 64))
    y = x + 0.75 * rng.standard_normal((400, 64))
    alike = (x * y).sum(axis=1) / np.linalg.norm(x, axis=1) / np.linalg.norm(y, axis=1) >= 0.605
    rows = [(f"{k}{i}", v.tolist()) for k, z in (("x", x), ("y", y)) for i, v in enumerate(z)]
    df = spark.createDataFrame(rows, "id string, embeddings array<float>")
    members, _ = clusters.cluster(df, least_size=2, row_edge=0.6, row_block=16, node_block=16, one_block=32)  # ends with joins over several groups
    got = {r["id"]: r["cluster"] for r in members.collect()}
    assert alike.sum() > 390 and all(got.get(f"x{i}", 0) == got.get(f"y{i}", 1) for i in np.flatnonzero(alike))


def test_blocks_have_no_most_links():
    rng = np.random.default_rng(7)
    x = np.zeros((640, 64))
    x[:, 0], x[:320, 1], x[320:, 1] = 1, 0.4, -0.4
    x[:, 2:] = 0.02 * rng.standard_normal((640, 62))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    assert (x @ x.T).min() > 0.6 and len(set(clusters.block_attractors(x, edge=0.6, power=0.0, inflation=2.0).tolist())) == 1  # links of one weight


def test_markov_by_joins_equals_one_block(spark):
    rng = np.random.default_rng(9)
    w = rng.random((30, 30)) * (rng.random((30, 30)) < 0.03)
    for g in range(3):
        w[g * 10 : g * 10 + 10, g * 10 : g * 10 + 10] = 1
    w = np.maximum(w, w.T)
    np.fill_diagonal(w, w.max(axis=1))
    i, j = np.nonzero(w)
    edges = spark.createDataFrame([(int(a), int(b), float(w[a, b])) for a, b in zip(i, j)], "i int, j int, w double")
    got = {r["node"]: r["attractor"] for r in clusters.markov(edges).collect()}
    own = clusters.flow_attractors(w)
    assert len({got[i] for i in range(30)}) == 3 and all((got[a] == got[b]) == (own[a] == own[b]) for a in range(30) for b in range(30))


def test_language_sentences_and_labels(spark):
    assert language.language_of("de-AT") == "de" and language.language_of("English") == "en" and language.language_of("xx") is None
    assert language.sentences("```code x```  12!") == []
    rng = random.Random(5)
    own = {lang: [f"{lang}{rng.choice('aeiou')}{i}ab"[:6].replace("0", "o") for i in range(40)] for lang in ("de", "en")}
    rows = [(i, " ".join(rng.choice(own[lang]) for _ in range(12)) + ".", lang) for i, lang in enumerate(["de", "en"] * 60)]
    rows += [(900, None, None), (901, "", "de"), (902, "!!!", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r["main"] for r in language.identify(df, language.fit(df)).collect()}
    assert got[900] is got[901] is got[902] is None and sum(got[r[0]] == r[2] for r in rows[:120]) >= 114


def test_personal_data(spark):
    users = ["+44 7700 900%03d" % (i * 137 % 1000) for i in range(20)] + ["QQ%06dC" % (i * 7919) for i in range(20)] + ["Deborah Lifat%s" % c for c in ("aso", "iso", "uso")]
    rows = [(f"m{i}", "Mobile +44 7700 900123. Ask Deborah Hupefalo, or ann@example.org. SKU 749-815-6193 ran out. Home address: 6 Brindlecote Lane." if i == 0 else "Nothing to see here.", u) for i, u in enumerate(users)] + [("x", None, None), ("y", "", "user-1")]
    df = spark.createDataFrame(rows, "memory_id string, content string, user_id string")
    alias = spark.createDataFrame([("Debbie", "Deborah")], "short_name string, given_name string")
    p = personal.learn(df, alias)
    got = {(r["kind"], r["found_value"]) for r in personal.found(df, p).where("field = 'content'").collect()}
    assert got == {("phone", "+44 7700 900123"), ("name", "Deborah Hupefalo"), ("email", "ann@example.org"), ("address", "6 Brindlecote Lane")}
    out = {r["memory_id"]: r["content"] for r in personal.redacted(df, p).collect()}
    assert out["m0"].startswith("Mobile [PHONE]. Ask [NAME], or [EMAIL].") and out["x"] is None and out["y"] == ""


def test_personal_data_learned_street_words_and_turned_names(spark):
    rows = [(f"s{i}", f"Home address: {i + 1} Oldmoor Lane.", None) for i in range(12)] + [(f"c{i}", f"Home address: {i + 3} Oldmoor Cresta.", None) for i in range(6)]
    rows += [(f"v{i}", f"We sold {i + 3} Large Boxes.", None) for i in range(9)] + [("t", "Hupefalo, Deborah wrote. MONDAY, Deborah left.", None), ("g", "x " * 40_000 + "Deborah Fesonda", None), (None, "Deborah Fesonda", None), ("e", " ", "")]
    df = spark.createDataFrame(rows, "memory_id string, content string, user_id string")
    p = personal.learn(df, spark.createDataFrame([("Debbie", "Deborah"), (None, None)], "short_name string, given_name string"))
    got = {(r["memory_id"], r["kind"], r["found_value"]) for r in personal.found(df, p).collect()}
    assert {("c0", "address", "3 Oldmoor Cresta"), ("s0", "address", "1 Oldmoor Lane"), ("t", "name", "Hupefalo, Deborah"), ("g", "name", "Deborah Fesonda")} <= got
    assert not {m for m, *_ in got} & {"v0", "v1", None, "e"}
    assert personal.found(df.limit(0), personal.learn(df.limit(0), df.limit(0).selectExpr("content short_name", "content given_name"))).count() == 0


def test_entities_of_many_given_names(spark):
    rng = random.Random(7)
    part = lambda k: "".join(rng.choice("bdfgklmnprstvz") + rng.choice("aeiou") for _ in range(k))
    given = sorted({part(3) + rng.choice("nlrs") for _ in range(900)})[:400]
    rows, want = [], set()
    for i in range(1500):
        g, last = rng.choice(given), part(4) + rng.choice("nlrst")
        rows.append((f"a{i:05d}", "person", f"{g.title()} {last.title()}"))
        if i < 150:  # two letters swapped in the given name
            k = rng.randrange(1, len(g) - 1)
            rows.append((f"b{i:05d}", "person", f"{(g[:k] + g[k + 1] + g[k] + g[k + 2 :]).title()} {last.title()}"))
            want.add((f"a{i:05d}", f"b{i:05d}"))
    df = spark.createDataFrame(rows, "id string, type string, name string")
    got = {tuple(r) for r in names.linked_pairs(names.entities(df, spark.createDataFrame([], "short_name string, given_name string"))).collect()}
    assert len(got & want) >= 0.95 * len(want) and len(got & want) >= 0.95 * len(got)


def test_mix_reaches_shares_within_caps(spark):
    try:
        bpe.vocabulary("byte_bpe_50k")
        bpe.encoder(bpe.vocabulary("byte_bpe_50k"))
    except OSError:
        pytest.skip("no vocabulary")
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(WORDS) for _ in range(rng.randrange(5, 60))), "a" if i < 200 else "b" if i < 260 else "c", 1) for i in range(300)]
    rows += [(900, None, "a", 1), (901, "", "b", 1), (902, "x y", None, 1), (903, "x y", "unwanted", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, repeats int")
    targets = spark.createDataFrame([("a", 0.4, 1), ("b", 0.4, 3), ("c", 0.2, 1), ("zero", 0.0, 2), ("gone", 0.0, None)], "source string, target_weight double, max_repeats int")
    mixed, report = mixing.mix(docs, targets)
    got = {r["doc_id"]: r["repeats"] for r in mixed.collect()}
    shares = {r["source"]: r for r in report.collect()}
    assert not {900, 901, 902, 903} & set(got) and max(got[i] for i in got if 200 <= i < 260) <= 3 and max(got[i] for i in got if i < 200) == 1
    for s in ("a", "b", "c"):
        planned = shares[s]["epochs"] * shares[s]["available_tokens"]
        assert abs(shares[s]["mixed_tokens"] - planned) <= 130 and shares[s]["epochs"] <= shares[s]["max_repeats"] + 1e-9
    assert {r["doc_id"]: r["repeats"] for r in mixing.mix(docs, targets)[0].collect()} == got
    assert mixing.mix(docs.limit(0), targets)[0].count() == 0


def test_near_copies_in_a_hot_bucket_and_groups(spark):
    rng = random.Random(12)
    base = [rng.choice(WORDS) for _ in range(40)]
    rows = []
    for i in range(60):  # all near-copies of one another, all different
        w = base[:]
        w[i % 40] = f"own{i}"
        rows.append((f"h{i:02d}", " ".join(w), 1))
    rows += [(f"c{i}", rows[0][1], 1) for i in range(3)] + [(f"o{i}", " ".join(rng.choice(WORDS) for _ in range(30)), 1) for i in range(40)] + [(None, rows[0][1], 1), ("e", None, 1)]
    df = spark.createDataFrame(rows, TEXTS)
    got = {(r["id_a"], r["id_b"]) for r in nearcopies.near_copy_pairs(df, hot=16).collect()}
    ids = [r[0] for r in rows[:63]]
    assert got == {(min(a, b), max(a, b)) for a in ids for b in ids if a != b}
    groups = {r["id"]: r for r in nearcopies.near_copy_groups(df, hot=16).collect()}
    assert set(groups) == set(ids) and all(r["group_size"] == 63 and r["group_id"] == "c0" and r["links"] == 59 for r in groups.values())
    assert nearcopies.near_copy_groups(df.limit(0)).count() == 0


def test_entities_in_crowded_blocks(spark):
    rows = [(f"{i:03d}", "person", f"Deborah Lifat{'aeiou'[i % 5]}s{'aeiou'[i // 5 % 5]}n") for i in range(25)] + [(f"x{i}", "person", f"Debora Lifat{'aeiou'[i % 5]}san") for i in range(5)]
    df = spark.createDataFrame(rows, "id string, type string, name string")
    alias = spark.createDataFrame([("Debbie", "Deborah")], "short_name string, given_name string")
    one, many = ({tuple(r) for r in names.linked_pairs(names.entities(df, alias, hot=hot)).collect()} for hot in (2000, 4))
    assert one == many and len(one) > 0


def test_language_segments_and_short_sentences(spark):
    rng = random.Random(6)
    own = {"de": [f"de{a}{b}z" for a in "aeiou" for b in "krst"], "en": [f"wy{a}{b}f" for a in "aeiou" for b in "lmnp"]}
    say = lambda lang, n: " ".join(rng.choice(own[lang]) for _ in range(n)).capitalize() + "."
    rows = [(i, say(lang, 12), lang) for i, lang in enumerate(["de", "en"] * 60)] + [(500, say("de", 14) + " " + say("en", 12) + " " + say("de", 12), "en"), (501, say("de", 14) + " " + say("en", 2), None), (502, None, "de")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("label", F.lit("clash"))
    found = language.identify(df, language.fit(df))
    seg = {r["doc_id"]: [(s["lang"], s["begin"], s["until"]) for s in r["segments"]] for r in found.where("doc_id >= 500").collect()}
    assert [s[0] for s in seg[500]] == ["de", "en", "de"] and seg[500][0][1] == 0 and seg[500][-1][2] == len(rows[120][1]) and seg[502] == []
    cases = {tuple(r) for r in language.wrong_or_further(found).where("doc_id >= 500").collect()}
    assert {(500, "main", "de"), (500, "also", "en"), (501, "main", "de"), (501, "also", "en")} == cases
