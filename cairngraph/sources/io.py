"""Readers and writers of stored graphs, logs, manifests, schemas, findings and rounds."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.exprs import lookup
from ..lineage import settle

GRAPH = "meta struct<project:string,analyzedAt:string>, nodes array<struct<id:string,type:string,label:string,data:string>>, edges array<struct<id:string,source:string,target:string,label:string,type:string>>"


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, edges and meta of stored tabs, one JSON document a file; the file's name is the tab."""
    raw = spark.read.schema(GRAPH).json(path, multiLine=True).select("*", F.regexp_replace(F.element_at(F.split("_metadata.file_path", "/"), -1), r"\.json$", "").alias("tab_id"))
    nodes = raw.select("tab_id", F.posexplode("nodes").alias("ord", "n")).select("tab_id", "ord", "n.*")
    edges = raw.select("tab_id", F.posexplode("edges").alias("ord", "e")).select("tab_id", "ord", "e.*")
    return nodes, edges, raw.select("tab_id", "meta.*")


def write_tabs(df: DataFrame, path: str, keys: tuple[str, ...] = ("tab_id",), fmt: str = "parquet") -> None:
    """Upsert by partition: tabs in df are replaced, all others stay."""
    df.write.format(fmt).mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).save(path)


def write_graph(tab_nodes: DataFrame, tab_edges: DataFrame, manifest: DataFrame, path: str) -> None:
    """Store each tab's subgraph as JSON lines, a folder a tab, and the manifest of all tabs.

    tab_nodes and tab_edges have tab_id; their tabs replace the stored ones.
    Rows are dealt by tab and a hash, so a large tab is written by many tasks.
    The manifest is written last: it names what is there.
    """
    for name, df, key in (("nodes", tab_nodes, "id"), ("edges", tab_edges, "source")):
        write_tabs(df.repartition("tab_id", F.pmod(F.xxhash64(key), F.lit(16))), f"{path}/{name}", fmt="json")
    manifest.write.mode("overwrite").json(f"{path}/manifest")


def read_tabs(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, edges and manifest of a graph stored by write_graph; tab ids stay texts."""
    node = "tab_id string, id string, type string, label string, data string, ord long"
    edge = "tab_id string, id string, source string, target string, label string, type string, ord long"
    entry = "tab_id string, label string, category string, route_count long, node_count long, edge_count long, issue_count long, risk_level string"
    return tuple(spark.read.schema(schema).json(f"{path}/{name}") for name, schema in (("nodes", node), ("edges", edge), ("manifest", entry)))


def upsert(df: DataFrame, path: str, key: str, buckets: int = 64) -> None:
    """Put rows into the table at path, one a key: stored rows of the same keys are replaced.

    Rows lie in ``buckets`` partitions by a hash of their key, of which only
    those that df touches are rewritten, from a stored copy, so a failed write
    can be repeated. Of rows of df that share a key the last in the order of
    their columns stays.
    """
    spark = df.sparkSession
    cols = [c for c in df.columns if c != key]
    last = df.groupBy(key).agg(F.max(F.struct(*cols)).alias("_row")).select(key, "_row.*")
    fresh = settle(last.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")))
    if exists(spark, path):
        stored = spark.read.parquet(path)
        touched = stored.join(fresh.select("bucket").distinct(), "bucket", "left_semi")
        fresh = settle(touched.join(fresh.select(key), key, "left_anti").unionByName(fresh))
    write_tabs(fresh, path, ("bucket",))


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a readable table lies at path."""
    try:
        spark.read.parquet(path)
    except AnalysisException:
        return False
    return True


def stale_tabs(stored: DataFrame, kept: DataFrame) -> DataFrame:
    """(tab_id) stored but not written by the latest run."""
    now = kept.select(F.col("tab_id").alias("_kept")).distinct()
    return stored.select("tab_id").distinct().join(now, F.col("tab_id").eqNullSafe(F.col("_kept")), "left_anti")


def prune_tabs(spark: SparkSession, table: str, kept: DataFrame) -> int:
    """Drop the partitions of tabs that are not in kept(tab_id), with their files, from a managed table partitioned by tab_id; how many.

    Only the names of stale partitions reach the driver, which holds the
    table's list of partitions anyway; no kept row is rewritten.
    """
    stale = [r.tab_id for r in stale_tabs(spark.table(table).select("tab_id"), kept).collect()]
    for tab in stale:
        name = "NULL" if tab is None else "'" + tab.replace("\\", "\\\\").replace("'", "\\'") + "'"
        spark.sql(f"ALTER TABLE {table} DROP IF EXISTS PARTITION (tab_id = {name})")
    return len(stale)


def table_stats(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """(table, rows, files, total_bytes) of Parquet tables."""
    out = None
    for name, path in paths.items():
        df = spark.read.parquet(path)
        files = df.select("_metadata.file_path", "_metadata.file_size").groupBy("file_path").agg(F.max("file_size").alias("size"), F.count("*").alias("n"))
        part = files.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count("*").alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("total_bytes")).select(F.lit(name).alias("table"), "rows", "files", "total_bytes")
        out = part if out is None else out.union(part)
    return out


def merge_stats(uniform: DataFrame, other: DataFrame) -> DataFrame:
    """(table, rows, table_bytes, index_bytes, total_bytes, estimated) of the tables of either reading.

    The uniform reading has (table, rows, total_bytes), the other also
    table_bytes and index_bytes. The uniform total is preferred; a table that
    only the other reading has is estimated.
    """
    a, b = uniform.alias("a"), other.alias("b")
    pick = lambda c: F.coalesce(f"a.{c}", f"b.{c}").alias(c)
    return a.join(b, "table", "full").select("table", pick("rows"), F.col("b.table_bytes"), F.col("b.index_bytes"), pick("total_bytes"), F.col("a.rows").isNull().alias("estimated"))


def read_commit_log(spark: SparkSession, path: str, since: str | None = None) -> DataFrame:
    """(commit_date, author, file, ord) of text logs: a line ``@@date␟author``, then the files, newest first.

    ord rises from the newest commit on. Of several log files the one whose
    newest commit is newer comes first, then that of the lesser path; inside a
    log its lines tell the order. Commits are counted in two levels, inside the
    blocks in which a log is read and over the blocks, of which there is one
    for each split. Lines before a log's first header are left out; a date that
    cannot be read is null, and such commits are not ``since`` any day.
    """
    place = (F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"))
    raw = spark.read.option("lineSep", "\n@@").text(path).select(*place, F.monotonically_increasing_id().alias("_o"), F.split(F.regexp_replace("value", "^@@", ""), "\n").alias("l"), F.col("value").startswith("@@").alias("_marked"))
    head = F.split(F.get("l", 0), "␟")
    date = F.try_to_date(F.get(head, 0))
    blocks = raw.groupBy("_file", "_block").agg(F.min("_o").alias("_low"), F.count("*").alias("_n"), F.max(date).alias("_day"))
    newest = F.max("_day").over(W.partitionBy("_file")).alias("_newest")
    in_order = W.orderBy(F.desc_nulls_last("_newest"), "_file", "_block").rowsBetween(W.unboundedPreceding, -1)
    blocks = blocks.select("*", newest).select("_file", "_block", "_low", F.coalesce(F.sum("_n").over(in_order), F.lit(0)).alias("_base"))
    commits = raw.join(blocks, ["_file", "_block"]).where("_block > 0 or _o > _low or _marked")
    found = commits.select(date.alias("commit_date"), F.get(head, 1).alias("author"), F.explode(F.slice("l", 2, F.size("l"))).alias("file"), (F.col("_base") + F.col("_o") - F.col("_low")).alias("ord"))
    found = found.where(F.length(F.trim("file")) > 0)
    return found if since is None else found.where(F.col("commit_date") >= F.to_date(F.lit(since)))


def fingerprint(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, hash, length) of a file tree's contents."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    return files.select("path", F.sha2("content", 256).alias("hash"), "length")


def content_hash(sources: DataFrame, key: str = "file") -> DataFrame:
    """(key, fingerprint) of sources(key, text); a null text counts as empty."""
    return sources.select(key, F.md5(F.coalesce("text", F.lit(""))).alias("fingerprint"))


def read_manifests(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """(project, package, version, dev) of package manifests with two dependency maps, one a file or one a line."""
    raw = spark.read.schema("name string, `require` map<string,string>, `require-dev` map<string,string>").json(path, multiLine=multi_line)
    part = lambda c, dev: raw.select(F.col("name").alias("project"), F.explode(c).alias("package", "version"), F.lit(dev).alias("dev"))
    return part("require", False).unionByName(part("`require-dev`", True))


def read_table_schemas(spark: SparkSession, path: str) -> DataFrame:
    """Catalogue extracts, one table a line; an unreadable line keeps its text in _corrupt_record and the rest is read."""
    schema = "table string, columns array<struct<name:string,type:string>>, indexes array<struct<name:string,columns:array<string>>>, foreign_keys array<struct<name:string,columns:array<string>,foreign_table:string>>, _corrupt_record string"
    return spark.read.schema(schema).option("mode", "PERMISSIVE").json(path)


def read_rounds(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """(arm, scenario, rep, ms, counts, phases) of benchmark rounds, one JSON document a file or one a line."""
    raw = spark.read.schema("arm string, scenarios map<string,struct<times_ms:array<double>,counts:map<string,bigint>,phases_ms:map<string,double>>>").json(path, multiLine=multi_line)
    each = raw.select("arm", F.explode("scenarios").alias("scenario", "s"))
    return each.select("arm", "scenario", F.posexplode("s.times_ms").alias("rep", "ms"), F.col("s.counts").alias("counts"), F.col("s.phases_ms").alias("phases"))


# Types of findings that are not their rule's last segment in capitals.
FINDING_TYPES = {
    "unsafe-validator": "UNVALIDATED_INPUT",
    "weak-validation": "UNVALIDATED_INPUT",
    "blade-raw-echo": "XSS_BLADE_UNESCAPED",
    "ssrf.http-client": "SSRF",
    "cookie-insecure": "INSECURE_COOKIE",
}


def read_findings(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """(file, line, type, severity, message, rule) of scanner reports with a list of findings, one JSON document a file or one a line."""
    raw = spark.read.schema("findings array<struct<file:string,line:int,ruleId:string,severity:string,message:string>>").json(path, multiLine=multi_line)
    return normalise_findings(raw.select(F.explode("findings").alias("f")).select("f.file", "f.line", F.col("f.ruleId").alias("rule"), "f.severity", "f.message"))


def normalise_findings(findings: DataFrame) -> DataFrame:
    """(file, line, type, severity, message, rule) of findings(file, line, rule, severity, message).

    Findings without a file go; a missing rule is unknown, a missing message
    the rule, a severity that is not low, medium, high or critical medium. The
    type is looked up by what follows the rule's first dot, else made of its
    last segment.
    """
    rule = F.coalesce("rule", F.lit("unknown"))
    made = F.upper(F.regexp_replace(F.substring_index(rule, ".", -1), "-", "_"))
    kind = F.coalesce(lookup(F.regexp_replace(rule, r"^[^.]*\.", ""), FINDING_TYPES), made)
    level = F.lower("severity")
    severity = F.when(level.isin("critical", "high", "medium", "low"), level).otherwise("medium")
    return findings.where("file is not null").select("file", "line", kind.alias("type"), severity.alias("severity"), F.coalesce("message", rule).alias("message"), rule.alias("rule"))
