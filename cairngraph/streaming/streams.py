"""Structured Streaming forms of the continuous jobs.

Each job is one function of DataFrames that a stream and a batch share: it
takes either, or a stream runs it on every micro-batch.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQueryListener
from pyspark.sql.window import Window as W

from ..lineage import settle
from ..operators.aggs import order_stats
from ..operators.diff import apply_partial, owned_equal
from ..sources import versions


def changes(rows: DataFrame) -> DataFrame:
    """rows(path, hash, ts, ...) whose hash differs from the path's one before, with change: added or modified.

    Rows of one path and ts follow one another by hash.
    """
    found = rows.withColumn("_before", F.lag("hash").over(W.partitionBy("path").orderBy("ts", "hash"))).where("_before is null or _before <> hash")
    return found.withColumn("change", F.when(F.col("_before").isNull(), "added").otherwise("modified")).drop("_before")


class LastHash(StatefulProcessor):
    """Keeps the last hash and time of each path, and tells the rows that change the hash.

    A path's rows of one micro-batch are taken by time and then hash. A row
    older than the path's last one is passed over. With a time to live in
    seconds a path that is not seen for so long is forgotten, and added anew.
    """

    def __init__(self, ttl: int | None = None):
        self.ttl = ttl

    def init(self, handle) -> None:
        self.last = handle.getValueState("last", "hash string, micros long", *([self.ttl * 1000] if self.ttl else []))

    def handleInputRows(self, key, rows, timers):
        before, since = self.last.get() if self.last.exists() else (None, None)
        for at, now in sorted((r.micros, r.hash) for r in rows):
            if since is not None and at < since:
                continue
            if since is None or now != before:
                yield Row(path=key[0], hash=now, micros=at, change="added" if since is None else "modified")
            before, since = now, at
        if since is not None:
            self.last.update((before, since))

    def close(self) -> None:
        pass


CHANGE = "path string, hash string, micros long, change string"


def tracked(rows: DataFrame, ttl: int | None = None) -> DataFrame:
    """(path, hash, ts, change): the changes of a stream or batch of rows(path, hash, ts), without nulls, by keyed state.

    A stream keeps one short row for each path in its state store, so a
    micro-batch costs what it holds and not what came before.
    """
    _ = rows.sparkSession.streams  # a batch's state is coordinated by them too
    known = rows.select("path", "hash", F.unix_micros("ts").alias("micros")).dropna()
    found = known.groupBy("path").transformWithState(LastHash(ttl), CHANGE, "Update", "ProcessingTime" if ttl else "None")
    return found.select("path", "hash", F.timestamp_micros("micros").alias("ts"), "change")


def change_feed(stream: DataFrame, path: str, checkpoint: str, ttl: int | None = None):
    """Start a query that appends the changes of a stream(path, hash, ts) to the Parquet table at path.

    Its state lies in a RocksDB store under the checkpoint, from where a
    restarted query goes on. A file source cannot show deletions;
    snapshot_diff on snapshots does. A path's rows of one micro-batch are
    sorted in memory; the source's limit of files a trigger bounds them.
    """
    conf, name = stream.sparkSession.conf, "spark.sql.streaming.stateStore.providerClass"
    before = conf.get(name)
    conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        out = tracked(stream, ttl).writeStream.outputMode("append").format("parquet").option("path", path)
        return out.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        conf.set(name, before)


def feed_state(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(path, hash, ts): the last of each path that a change feed knows, read from its state store."""
    return spark.read.format("statestore").option("stateVarName", "last").load(checkpoint).select("key.path", "value.hash", F.timestamp_micros("value.micros").alias("ts"))


def churn_windows(stream: DataFrame, size: str, slide: str, delay: str) -> DataFrame:
    """(start, key, commits) over sliding windows of (ts, key); a stream drops rows later than delay."""
    counted = stream.withWatermark("ts", delay).groupBy(F.window("ts", size, slide), "key").agg(F.count("*").alias("commits"))
    return counted.select(F.col("window.start").alias("start"), "key", "commits")


def timing_windows(stream: DataFrame, size: str, delay: str) -> DataFrame:
    """(start, key, n, low, high, p95) over tumbling windows of (ts, key, ms).

    The 95th percentile is exact on a batch and approximate, to one rank in
    ten thousand, on a stream, whose state must stay small.
    """
    if stream.isStreaming:
        summed = stream.withWatermark("ts", delay).groupBy(F.window("ts", size), "key")
        out = summed.agg(F.count("*").alias("n"), F.min("ms").alias("low"), F.max("ms").alias("high"), F.percentile_approx("ms", 0.95).alias("p95"))
        return out.select(F.col("window.start").alias("start"), "key", "n", "low", "high", "p95")
    rows = stream.select(F.window("ts", size)["start"].alias("start"), "key", "ms")
    rank = F.greatest(F.ceil(F.lit(0.95) * F.col("n")) - 1, F.lit(0))
    return order_stats(rows, ["start", "key"], "ms", {"p95": rank}).select("start", "key", "n", "low", "high", "p95")


def dedupe_events(stream: DataFrame, keys: Sequence[str], delay: str) -> DataFrame:
    """The first row of each key by ts; a stream keeps a key's first arrival until the watermark has passed it by delay."""
    if stream.isStreaming:
        return stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark(list(keys))
    rest = [c for c in stream.columns if c not in keys and c != "ts"]
    first = stream.groupBy(*keys).agg(F.min(F.struct("ts", *rest)).alias("_row"))
    return first.select(*keys, "_row.*").select(*stream.columns)


def session_cascade(stream: DataFrame, gap: str, delay: str) -> DataFrame:
    """(user_id, start, events, kinds, transitions) of (user_id, ts, event_type), per burst of a user's events.

    ``transitions`` has (before, after, n) for each pair of events that follow
    one another in the burst, by time and then type, in order.
    """
    bursts = stream.withWatermark("ts", delay).groupBy(F.session_window("ts", gap).alias("w"), "user_id")
    held = bursts.agg(F.array_sort(F.collect_list(F.struct("ts", "event_type"))).alias("_all"))
    kinds = F.transform("_all", lambda e: e["event_type"])
    n = F.size("_all")
    steps = F.zip_with(F.slice(kinds, 1, n - 1), F.slice(kinds, 2, n - 1), lambda a, b: F.struct(a.alias("before"), b.alias("after")))
    count = lambda step: F.struct(step["before"].alias("before"), step["after"].alias("after"), F.size(F.filter(steps, lambda s: s == step)).alias("n"))
    counted = F.transform(F.array_sort(F.array_distinct(steps)), count)
    return held.select("user_id", F.col("w.start").alias("start"), n.cast("long").alias("events"), F.size(F.array_distinct(kinds)).cast("long").alias("kinds"), counted.alias("transitions"))


def merge_files(nodes_path: str, partial_nodes: DataFrame, old_edges: DataFrame, partial_edges: DataFrame, files: DataFrame, rebuild: Callable[[], DataFrame]) -> str:
    """Fold the changed files(file) into the stored nodes(id, label, ord, file), which lie by file; scoped or full.

    If the files own the same edges in both builds their nodes are replaced
    where they lie and no other file is written. Otherwise nothing here stands
    in for a full run, and ``rebuild`` gives the nodes of one; so it does where
    a file loses all its nodes or a node moves from a file that is not listed.
    Either way a repeated call gives the same table.
    """
    spark = partial_nodes.sparkSession
    old = spark.read.parquet(nodes_path)
    inside = old.join(files, "file", "left_semi")
    moved = old.join(files, "file", "left_anti").join(partial_nodes.select("id"), "id", "left_semi")
    nodes, _ = apply_partial(inside, old_edges, partial_nodes, files)
    nodes = settle(nodes)
    emptied = inside.select("file").distinct().join(nodes.select("file"), "file", "left_anti")
    if not (moved.isEmpty() and emptied.isEmpty() and owned_equal(old, old_edges, partial_nodes, partial_edges, files).first()["equal"]):
        settle(rebuild().select(*old.columns)).repartitionByRange("file", "id").write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("file").parquet(nodes_path)
        return "full"
    nodes.repartitionByRange("file", "id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("file").parquet(nodes_path)
    return "scoped"


def incremental_merge(stream: DataFrame, nodes_path: str, checkpoint: str, edges_of: Callable[[DataFrame], tuple[DataFrame, DataFrame]], rebuild: Callable[[], DataFrame]):
    """Start a query that merges, batch by batch, the files of a stream(id, label, ord, file) into the stored nodes.

    A file's rows come together. ``edges_of(files)`` gives the old and the new
    edges, ``rebuild()`` the nodes of a full run; see merge_files.
    """

    def put(batch: DataFrame, _: int) -> None:
        rows = settle(batch.dropDuplicates(["file", "id"]))
        files = rows.select("file").distinct()
        old_edges, new_edges = edges_of(files)
        merge_files(nodes_path, rows, old_edges, new_edges, files, rebuild)

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def merge_version(spark: SparkSession, root: str, partial_nodes: DataFrame, partial_edges: DataFrame, files: DataFrame, rebuild: Callable[[], tuple[DataFrame, DataFrame]], told: str | None = None) -> str:
    """Fold the nodes(id, label, ord, file) and edges(source, target, type, file) of the changed files(file) into the store at root, as its next version; scoped or full.

    A full run is needed where the files own other edges than before, where a
    file loses all its nodes, and where a node moves from a file that is not
    listed; ``rebuild`` gives its nodes and edges. Readers see the version
    before or the next one. Of rows of one file and id the first in the order
    of their columns stays.
    """
    after = versions.versions(spark, root)[-1]
    old_nodes, old_edges = (versions.read(spark, root, name, after) for name in ("nodes", "edges"))
    first = F.row_number().over(W.partitionBy("file", "id").orderBy("label", "ord"))
    fresh = partial_nodes.withColumn("_n", first).where("_n = 1").drop("_n")
    inside = old_nodes.join(files, "file", "left_semi")
    moved = old_nodes.join(files, "file", "left_anti").join(fresh.select("id"), "id", "left_semi")
    keys = ["source", "target", "type"]
    nodes = settle(apply_partial(inside, old_edges.select(*keys), fresh, files)[0])
    emptied = inside.select("file").distinct().join(nodes.select("file"), "file", "left_anti")
    if moved.isEmpty() and emptied.isEmpty() and owned_equal(old_nodes, old_edges.select(*keys), fresh, partial_edges.select(*keys), files).first()["equal"]:
        versions.publish(spark, root, {"nodes": nodes.select(*old_nodes.columns), "edges": partial_edges.join(files, "file", "left_semi").select(*old_edges.columns)}, {"nodes": files, "edges": files}, told=told, after=after)
        return "scoped"
    whole_nodes, whole_edges = rebuild()
    versions.publish(spark, root, {"nodes": whole_nodes.select(*old_nodes.columns), "edges": whole_edges.select(*old_edges.columns)}, told=told, after=after)
    return "full"


def versioned_merge(stream: DataFrame, root: str, checkpoint: str, edges_of: Callable[[DataFrame], DataFrame], rebuild: Callable[[], tuple[DataFrame, DataFrame]]):
    """Start a query that merges, batch by batch, the files of a stream(id, label, ord, file) into the store at root.

    ``edges_of(files)`` gives the new edges of files. Each version notes the
    query's checkpoint and its micro-batch, so a repeated one is not merged
    again.
    """

    def put(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        noted = versions.note(spark, root) or ""
        at, _, done = noted.rpartition("#")
        if at == checkpoint and int(done) >= number:
            return
        rows = settle(batch)
        files = rows.select("file").distinct()
        merge_version(spark, root, rows, edges_of(files), files, rebuild, f"{checkpoint}#{number}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class LateRows(StreamingQueryListener):
    """Counts, for each micro-batch of the queries of a session, the rows dropped as later than the watermark.

    It is added to the session's streams and keeps every micro-batch with a
    late row, where a query's own progress forgets all but the last hundred.
    """

    def __init__(self):
        self.counts: dict[tuple[str, int], int] = {}

    def onQueryProgress(self, event) -> None:
        p = event.progress
        late = sum(op.numRowsDroppedByWatermark for op in p.stateOperators)
        if late:
            self.counts[str(p.id), p.batchId] = late

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def of(self, query) -> int:
        """Late rows of one query, over all its runs since the listener was added."""
        return sum(n for (at, _), n in list(self.counts.items()) if at == str(query.id))

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(q, b, n) for (q, b), n in sorted(self.counts.items())], "query string, batch long, late long")


def late_rows(query) -> int:
    """Rows that a streaming query has dropped as later than its watermark, by its recent progress; LateRows counts all."""
    return sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])


def backfill(rows: DataFrame, path: str, days: DataFrame | Sequence[str], job: Callable[[DataFrame], DataFrame], lead: int = 0) -> None:
    """Compute the days(day) of the table at path, partitioned by day, anew from all rows(ts, ...), late ones included.

    ``job`` is the batch form of the windows and gives (start, ...); rows from
    ``lead`` days before and behind a day are read too, as its windows may
    begin or end there. Rows and windows are chosen by joins on their day.
    """
    if not isinstance(days, DataFrame):
        days = rows.sparkSession.createDataFrame([(d,) for d in days], "day string")
    wanted = days.select(F.col("day").cast("date").alias("day")).distinct()
    near = wanted.select(F.explode(F.sequence(F.date_sub("day", lead), F.date_add("day", lead + (lead > 0)))).alias("_day")).distinct()
    made = job(rows.withColumn("_day", F.to_date("ts")).join(near, "_day", "left_semi").drop("_day")).withColumn("day", F.to_date("start"))
    settle(made.join(wanted, "day", "left_semi")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)
