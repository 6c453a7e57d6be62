"""Versions of a stored graph, and what their readers see."""

import pytest
from pyspark.sql import functions as F

from cairngraph.operators import diff
from cairngraph.sources import versions
from cairngraph.streaming import streams

NODE, EDGE = "id string, label string, ord long, file string", "source string, target string, type string, file string"


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols or df.columns).collect()), key=str)


def graph(spark, label="1"):
    nodes = spark.createDataFrame([("a", label, 0, "f"), ("b", label, 1, "g"), ("c", label, 2, "f"), ("n", label, 3, None)], NODE)
    return nodes, spark.createDataFrame([("a", "b", "t", "f"), ("b", "c", "t", "g")], EDGE)


def test_readers_keep_the_version_they_read(spark, tmp_path):
    root = str(tmp_path / "s p")
    nodes, edges = graph(spark)
    with pytest.raises(ValueError):
        versions.read(spark, root, "nodes")
    assert versions.publish(spark, root, {"nodes": nodes, "edges": edges}, told="first") == 1
    before = versions.read(spark, root, "nodes")
    files = spark.createDataFrame([("f",), (None,)], "file string")
    changed = spark.createDataFrame([("a", "2", 0, "f")], NODE)
    assert versions.publish(spark, root, {"nodes": changed}, {"nodes": files}, after=1) == 2
    assert rows(before) == rows(nodes) and rows(versions.read(spark, root, "nodes", 1)) == rows(nodes)
    assert rows(versions.read(spark, root, "nodes")) == [("a", "2", 0, "f"), ("b", "1", 1, "g")]
    assert rows(versions.read(spark, root, "edges")) == rows(edges)
    assert (versions.note(spark, root, 1), versions.note(spark, root)) == ("first", None)
    with pytest.raises(RuntimeError):
        versions.publish(spark, root, {"nodes": nodes}, after=1)
    with pytest.raises(Exception):
        versions.publish(spark, root, {"nodes": nodes, "edges": edges.select(F.raise_error(F.lit("lost")).alias("x"))})
    assert versions.versions(spark, root) == [1, 2] and versions.read(spark, root, "nodes").count() == 2
    signs = [diff.graph_signature(versions.read(spark, root, "nodes", v).select("id", F.lit("t").alias("type"), "label"), edges.withColumn("label", F.lit(None).cast("string"))) for v in (1, 2)]
    assert {r.id for r in diff.signature_diff(*signs).collect()} == {"a", "c", "n"}
    assert versions.forget(spark, root, keep=1) == 1 and versions.versions(spark, root) == [2]
    assert rows(versions.read(spark, root, "nodes")) == [("a", "2", 0, "f"), ("b", "1", 1, "g")]


def test_many_partial_versions_are_put_together(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(versions, "SEGMENTS", 2)
    root, nodes = str(tmp_path), graph(spark)[0]
    versions.publish(spark, root, {"nodes": nodes})
    for n in range(3):
        versions.publish(spark, root, {"nodes": nodes.where("id = 'a'").withColumn("label", F.lit(f"x{n}"))}, {"nodes": spark.createDataFrame([("f",)], "file string")})
    assert rows(versions.read(spark, root, "nodes"), "id", "label") == [("a", "x2"), ("b", "1"), ("n", "1")]
    assert [versions.read(spark, root, "nodes", v).count() for v in (1, 2, 3, 4)] == [4, 3, 3, 3]


def test_a_stream_merges_each_batch_once(spark, tmp_path):
    root, feed, marks = (str(tmp_path / x) for x in ("store", "in", "marks"))
    nodes, edges = graph(spark)
    versions.publish(spark, root, {"nodes": nodes.where("file is not null"), "edges": edges})
    full = (nodes.withColumn("label", F.lit("full")), edges.withColumn("type", F.lit("u")))

    def run(facts, now):
        spark.createDataFrame(facts, NODE).coalesce(1).write.mode("append").parquet(feed)
        streams.versioned_merge(spark.readStream.schema(NODE).parquet(feed), root, marks, lambda files: now.join(files, "file", "left_semi"), lambda: full).awaitTermination(120)
        return rows(versions.read(spark, root, "nodes"), "id", "label", "ord")

    assert run([("a", "3", 9, "f"), ("a", "2", 9, "f"), ("c", "2", 9, "f")], edges) == [("a", "2", 0), ("b", "1", 1), ("c", "2", 2)]
    assert versions.note(spark, root) == f"{marks}#0" and versions.read(spark, root, "edges").count() == 2
    assert run([("b", "4", 9, "g")], edges.withColumn("type", F.lit("v"))) == rows(full[0], "id", "label", "ord")
    assert {r.type for r in versions.read(spark, root, "edges").collect()} == {"u"}
    assert versions.versions(spark, root) == [1, 2, 3]
