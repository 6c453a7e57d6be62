"""Keyed state, late rows and nested steps."""

import json
import random

from pyspark.sql import functions as F

from cairngraph.operators import graph
from cairngraph.streaming import streams


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def feed(spark, tmp_path, *facts, ttl=None):
    spark.createDataFrame([(p, h, f"2024-01-01 00:00:{t:02d}") for p, h, t in facts], "path string, hash string, t string").select("path", "hash", F.to_timestamp("t").alias("ts")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("path string, hash string, ts timestamp").parquet(str(tmp_path / "in"))
    streams.change_feed(stream, str(tmp_path / "out"), str(tmp_path / "ck"), ttl).awaitTermination(120)
    return rows(spark.read.parquet(str(tmp_path / "out")).select("path", "hash", F.second("ts"), "change"))


def test_the_feed_goes_on_from_its_state(spark, tmp_path):
    provider = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    assert feed(spark, tmp_path, ("a", "1", 1), ("b", "2", 5), ("b", "1", 5), (None, "1", 1), ("c", None, 1)) == [("a", "1", 1, "added"), ("b", "1", 5, "added"), ("b", "2", 5, "modified")]
    assert rows(streams.feed_state(spark, str(tmp_path / "ck")).select("path", "hash", F.second("ts"))) == [("a", "1", 1), ("b", "2", 5)]
    got = feed(spark, tmp_path, ("a", "1", 7), ("b", "1", 4), ("b", "3", 9), ("c", "1", 2))
    assert [r for r in got if r[2] > 5 or r[0] == "c"] == [("b", "3", 9, "modified"), ("c", "1", 2, "added")] and len(got) == 5
    assert rows(streams.feed_state(spark, str(tmp_path / "ck")).select("path", "hash", F.second("ts"))) == [("a", "1", 7), ("b", "3", 9), ("c", "1", 2)]
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == provider


def test_a_feed_with_a_time_to_live(spark, tmp_path):
    assert feed(spark, tmp_path, ("a", "1", 1), ttl=3600) == [("a", "1", 1, "added")]
    assert feed(spark, tmp_path, ("a", "1", 2), ("a", "2", 3), ttl=3600) == [("a", "1", 1, "added"), ("a", "2", 3, "modified")]


def test_state_over_a_batch_equals_the_window(spark):
    rng = random.Random(4)
    facts = [(f"p{rng.randrange(5)}", str(rng.randrange(3)), rng.randrange(40)) for _ in range(120)]
    df = spark.createDataFrame(facts, "path string, hash string, t int").select("path", "hash", F.timestamp_seconds("t").alias("ts")).distinct()
    assert rows(streams.tracked(df)) == rows(streams.changes(df).select("path", "hash", "ts", "change"))


def test_late_rows_of_more_batches_than_progress_is_kept_for(spark, tmp_path):
    heard = streams.LateRows()
    spark.streams.addListener(heard)
    try:
        def put(name, hours):
            spark.createDataFrame([(f"2024-01-{1 + h // 24:02d} {h % 24:02d}:00:00", "k") for h in hours], "t string, key string").select(F.to_timestamp("t").alias("ts"), "key").coalesce(1).write.parquet(str(tmp_path / "in" / name))

        put("a", [100])
        for n in range(6):
            put(f"b{n}", [200 + n, 1])
        stream = spark.readStream.schema("ts timestamp, key string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
        q = streams.churn_windows(stream, "1 day", "1 day", "1 hour").writeStream.format("noop").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        q.awaitTermination(200)
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    finally:
        spark.streams.removeListener(heard)
    assert heard.of(q) == streams.late_rows(q) >= 5
    table = heard.table(spark)
    assert table.agg(F.sum("late")).first()[0] == heard.of(q) and table.select("batch").distinct().count() == table.count() >= 5


def test_backfill_takes_days_as_a_table(spark, tmp_path):
    at = spark.createDataFrame([(f"2024-01-{d:02d} 05:00:00", "k") for d in (1, 1, 2, 3)], "t string, key string").select(F.to_timestamp("t").alias("ts"), "key")
    daily = lambda df: streams.churn_windows(df, "1 day", "1 day", "1 hour")
    days = spark.createDataFrame([("2024-01-01",), ("2024-01-03",), ("2024-01-01",)], "day string")
    streams.backfill(at, str(tmp_path / "days"), days, daily, lead=1)
    assert rows(spark.read.parquet(str(tmp_path / "days")).select(F.col("day").cast("string"), "commits")) == [("2024-01-01", 2), ("2024-01-03", 1)]


def tree(rng, deep=0):
    out = []
    for _ in range(rng.randint(0, 3 if deep else 4)):
        step = {"type": rng.choice(["if", "loop", "try", "call"])}
        if rng.random() < 0.1:
            step["n1"] = rng.choice([True, False, None])
        if rng.random() < 0.4:
            step["http"] = [{"verb": rng.choice("GP"), "host": rng.randrange(3)} for _ in range(rng.randint(0, 3))]
        for name in ("then", "else", "body"):
            if deep < 2 and rng.random() < 0.5:
                step[name] = tree(rng, deep + 1)
        out.append(step)
    return out


def has_n1(steps):
    return any(s.get("n1") or (s["type"] == "if" and (has_n1(s.get("then", [])) or has_n1(s.get("else", [])))) or (s["type"] == "loop" and has_n1(s.get("body", []))) for s in steps)


def calls(steps):
    return {json.dumps(c, sort_keys=True) for s in steps for c in s.get("http", [])} | {c for s in steps for b in ("then", "else", "body") for c in calls(s.get(b, []))}


def test_steps_are_walked_to_any_depth(spark):
    rng = random.Random(2)
    trees = {n: tree(rng) for n in range(30)}
    deep = [{"type": "call", "n1": True, "http": [{"verb": "X"}]}]
    for _ in range(3):
        deep = [{"type": "loop", "body": deep}]
    trees |= {100: deep, 101: [], 102: [{"type": "try", "body": deep}]}
    raw = [(n, json.dumps(t)) for n, t in trees.items()] + [(200, None), (201, '{"type": "if"}'), (202, "[1, null]")]
    df = spark.createDataFrame(raw, "node_id long, t string").select("node_id", F.parse_json("t").alias("steps"))
    got = {r.node_id: r.n1 for r in graph.any_flag_in_trees(df, "n1").collect()}
    assert got == {n: has_n1(t) for n, t in trees.items()} | {200: False, 201: False, 202: False}
    assert {(r.node_id, json.dumps(json.loads(r.call), sort_keys=True)) for r in graph.calls_in_trees(df, "http").collect()} == {(n, c) for n, t in trees.items() for c in calls(t)}
    places = [r.path for r in graph.walk_steps(df.where("node_id = 102"), graph.CALL_BRANCHES).collect()]
    assert max(places, key=len) == "0" + ".body.0" * 4
