import datetime as dt
import json
import os

import pytest
from pyspark.sql import functions as F

from spindrel.operators import ranking
from spindrel.plans.memory import Memory
from spindrel.sources import graphs
from spindrel.streaming.events import session_counts, windowed_counts
from spindrel.streaming.intervals import stream_gaps

T0 = dt.datetime(2025, 1, 1)


def at(day):
    return F.lit(T0 + dt.timedelta(days=day))


def test_graph_store_versions_tombstones_snapshots(spark, tmp_path):
    store = graphs.GraphStore(spark, graphs.StorageConfig(str(tmp_path / "g")))
    nodes = spark.createDataFrame([("a", "person", {"name": "Ann"}), ("b", "org", None)], "id string, type string, properties map<string,string>")
    edges = spark.createDataFrame([("e", "a", "b", "knows", 0.5)], "id string, source string, target string, type string, weight double")
    assert store.load_nodes().count() == 0
    store.store_nodes(nodes, at(0))
    store.store_edges(edges, at(0))
    store.store_nodes(nodes.where("id = 'a'").withColumn("type", F.lit("Person")), at(1))
    assert {(r["id"], r["type"]) for r in store.load_nodes().collect()} == {("a", "Person"), ("b", "org")}
    assert [r["id"] for r in store.load_nodes(["org"]).collect()] == ["b"] and store.index("node").count() == 3
    store.snapshot("one")
    store.delete(spark.createDataFrame([("b",)], "id string"), "node", at(2))
    assert [r["id"] for r in store.load_nodes().collect()] == ["a"] and store.stats("node").agg(F.sum("items")).first()[0] == 3
    store.restore("one")
    assert store.load_nodes().count() == 2 and store.load_edges().first()["weight"] == 0.5
    assert store.snapshots()[0][0] == "one" and store.drop_old_snapshots(0) == [] and store.drop_old_snapshots(2**50) == ["one"]
    with open(next((tmp_path / "g" / "node").glob("*.gz")).parent / "bad.json", "w") as f:
        f.write('not json\n\n{"type":"node","data":{"id":"c"},"timestamp":"2025-01-01T00:00:00Z"}\n')
    assert store.broken_lines("node") == 1 and store.load_nodes().count() == 3
    store.clear()
    assert store.load_nodes().count() == 0
    with pytest.raises(ValueError):
        graphs.GraphStore(spark, graphs.StorageConfig("", "brotli", -1))


def test_write_behind_of_a_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.json").write_text('{"id":"a","type":"x"}\n{"id":"b","type":"y"}\n')
    store = graphs.GraphStore(spark, graphs.StorageConfig(str(tmp_path / "g")))
    stream = spark.readStream.schema("id string, type string").json(str(tmp_path / "in"))
    store.sync(stream, "node", "now", str(tmp_path / "cp")).awaitTermination()
    assert {r["id"] for r in store.load_nodes().collect()} == {"a", "b"}


def test_pages_memories_and_tables(spark, tmp_path):
    df = spark.range(10)
    rows, more = graphs.page(df, [F.col("id")], 4, 3)
    assert [r["id"] for r in rows.collect()] == [4, 5, 6] and more and not graphs.page(df, [F.col("id")], 8, 3)[1]
    lines = [{"content": "x", "userId": "u"}, {"content": 5}, {"userId": "v"}]
    (tmp_path / "m.jsonl").write_text("\n".join(map(json.dumps, lines)) + "\n\nbroken\n")
    assert tuple(graphs.check_memories(spark, str(tmp_path / "m.jsonl")).first()) == (1, 3)
    assert "x" in {r["content"] for r in graphs.read_memories(spark, str(tmp_path / "m.jsonl")).collect()}
    store = graphs.TableStore(spark, str(tmp_path / "t"))
    store.write("links", spark.createDataFrame([("l", 1)], "id string, v int"), F.lit("s1"), at(0))
    store.write("links", spark.createDataFrame([("l", 2), ("k", 3)], "id string, v int"), F.lit("s1"), at(1))
    store.write("links", spark.createDataFrame([("l", 9)], "id string, v int"), F.lit("s2"), at(2))
    assert {(r["id"], r["v"]) for r in store.read("links", graphs=["s1"]).collect()} == {("l", 2), ("k", 3)}
    assert store.read("links", limit=1).first()["v"] == 9 and store.read("links", since=at(2)).count() == 1


def test_memory_engine(spark, tmp_path):
    memory = Memory(spark, str(tmp_path / "m"))
    rows = [("1", "Alice Moor works at TechCorp in the northern quarter of the old city. Alice Moor leads Marketing Group since the spring of that year.", "s1", T0), ("2", None, "s1", T0), ("3", " ", None, T0)]
    df = spark.createDataFrame(rows, "id string, text string, session string, ts timestamp").withColumn("extra", F.lit(1))
    added = memory.add(df, at=at(0))
    assert added.chunks == 2 and added.entities >= 3 and added.relationships >= 2 and added.links >= 2 and added.merged == 0
    again = memory.add(df.withColumn("session", F.lit("s2")), at=at(1))
    assert again.merged >= 3
    assert memory.totals()["chunks"] == 4 and memory.table("chunks", ["s1"]).count() == 2
    got = memory.query(ranking.Query(text="techcorp", entity_types=["organization"], relation_types=["works_at"]), graphs=["s1"]).collect()
    assert {r["kind"] for r in got} == {"chunk", "entity", "relationship"} and got[0]["score"] == max(r["score"] for r in got)
    memory.mark(memory.table("chunks", ["s1"]).select("id"), at(3))
    assert memory.query(ranking.Query(text="techcorp", limit=3)).count() == 3
    assert memory.forget(3).count() == 4
    memory.clear()
    assert memory.query(ranking.Query(text="techcorp")).count() == 0


def test_stream_of_gaps_ends_like_the_batch(spark, tmp_path):
    from spindrel.operators import intervals

    rows = [("a", 0, 10), ("a", 20, 30), ("a", 5, 15), ("b", 0, None), ("a", 40, 41), (None, 1, 2)]
    (tmp_path / "in").mkdir()
    for i in range(3):
        (tmp_path / "in" / f"{i}.json").write_text("\n".join(json.dumps({"k": k, "s": s, "e": e}) for k, s, e in rows[2 * i : 2 * i + 2]))
    ts = lambda df: df.select("k", F.timestamp_seconds("s").alias("s"), F.timestamp_seconds("e").alias("e"))
    stream = ts(spark.readStream.schema("k string, s long, e long").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in")))
    last: dict = {}

    def keep(df, batch):
        for r in df.collect():
            if last.get(r["k"], (-1, None))[0] < batch:
                last[r["k"]] = (batch, set())
            if r["gap_from"] is not None:
                last[r["k"]][1].add((r["gap_from"], r["gap_until"]))

    q = stream_gaps(stream, ["k"], "s", "e").writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    batch = ts(spark.createDataFrame(rows, "k string, s long, e long"))
    want = {(r["k"], r["gap_from"], r["gap_until"]) for r in intervals.gaps(batch, ["k"], "s", "e").collect()}
    assert {(k, a, b) for k, (_, g) in last.items() for a, b in g} == want and len(want) == 2


def test_windows_of_streams_equal_batches(spark, tmp_path):
    rows = [{"user_id": i % 2, "event_type": "x", "value": 1.0, "ts": f"2025-01-01T00:{m:02d}:00Z"} for i, m in enumerate((0, 5, 20, 50, 59))] + [{"user_id": 0, "event_type": "x", "value": 1.0, "ts": "2025-01-02T00:00:00Z"}]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.json").write_text("\n".join(map(json.dumps, rows)))
    schema = "user_id int, event_type string, value double, ts timestamp"
    batch, stream = spark.read.schema(schema).json(str(tmp_path / "in")), spark.readStream.schema(schema).json(str(tmp_path / "in"))
    assert session_counts(batch, "ts", "10 minutes", "user_id").count() == 6
    got = []
    q = windowed_counts(stream, "ts", "30 minutes", late="1 hour").writeStream.outputMode("append").foreachBatch(lambda df, _: got.extend(df.collect())).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    want = {tuple(r) for r in windowed_counts(batch, "ts", "30 minutes").collect() if r["begin"].day == 1}
    assert {tuple(r) for r in got} == want and len(want) == 2


def test_stream_of_sequences_equals_the_batch(spark, tmp_path):
    from spindrel.operators import temporal
    from spindrel.streaming.sequences import stream_sequences

    rows = [(i, k, s, e) for i, (k, s, e) in enumerate([("a", 0, "click"), ("b", 0, "click"), ("c", 0, "click"), ("a", 50, "purchase"), ("b", 90, "purchase"), ("c", 50, "click"), ("c", 100, "purchase"), ("a", 120, "click"), (None, 0, "click"), ("d", 5, "purchase"), ("d", 7, "click"), ("d", 9, "purchase")])]
    (tmp_path / "in").mkdir()
    for i in range(3):
        (tmp_path / "in" / f"{i}.json").write_text("\n".join(json.dumps({"event_id": n, "k": k, "s": s, "kind": e}) for n, k, s, e in rows[4 * i : 4 * i + 4]))
        os.utime(tmp_path / "in" / f"{i}.json", (1_700_000_000 + i, 1_700_000_000 + i))
    ts = lambda df: df.select("event_id", "k", F.timestamp_seconds("s").alias("ts"), "kind")
    stream = ts(spark.readStream.schema("event_id int, k string, s long, kind string").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in")))
    got = []
    q = stream_sequences(stream, "k", "ts", "kind", ["click", "purchase"], 60_000).writeStream.outputMode("append").foreachBatch(lambda df, _: got.extend(r["k"] for r in df.collect())).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    batch = ts(spark.createDataFrame(rows, "event_id int, k string, s long, kind string"))
    assert sorted(got) == sorted(r["k"] for r in temporal.has_sequence(batch, "k", "ts", "kind", ["click", "purchase"], 60_000).collect()) == ["a", "d"]


def test_providers(spark):
    from spindrel.functions import providers

    df = spark.createDataFrame([("1", "x"), ("2", "x"), ("3", None), ("4", "bad"), ("5", " ")], "id string, t string").withColumn("_v0", F.lit(1))
    got = {r["id"]: (r["embedding"], r["embedding_ok"]) for r in providers.embed(df, "t", lambda ts: [[1.0]] * len(ts) if "bad" not in ts else 1 / 0, 1, batch=1).collect()}
    assert got == {"1": ([1.0], True), "2": ([1.0], True), "3": (None, None), "4": ([0.0], False), "5": (None, None)}
    images = spark.createDataFrame([("a", b"1"), ("b", b"1"), ("c", None)], "id string, data binary")
    assert {(r["id"], r["description"], r["ok"]) for r in providers.describe(images, "id", "data", lambda xs: ["seen"] * len(xs)).collect()} == {("a", "seen", True), ("b", "seen", True)}
    assert providers.describe(images, "id", "data", lambda xs: 1 / 0).where("not ok").count() == 2
