"""Graph tables: validation, merging, identity, fan-in, degree and counts."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.exprs import lookup, max_severity, severity_rank
from ..lineage import stored


def valid_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges whose two ends exist."""
    ids = nodes.select("id").distinct()
    return edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi").select(*edges.columns)


def placeholders(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, external): ends of edges that are no node."""
    ends = edges.select(F.col("source").alias("id")).union(edges.select("target")).distinct()
    return ends.join(nodes.select("id"), "id", "left_anti").withColumn("external", F.lit(True))


def merge_graphs(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One graph from stored tabs: the last writer (ord) of a node or edge id wins; blank node ids go; an edge without an id is named source|target|type."""
    last = lambda key: F.row_number().over(W.partitionBy(key).orderBy(F.desc("ord")))
    n = nodes.where("id is not null and id <> ''").withColumn("_n", last("id")).where("_n = 1").drop("_n")
    named = edges.withColumn("id", F.coalesce(F.nullif("id", F.lit("")), F.concat_ws("|", "source", "target", "type")))
    return n, named.withColumn("_n", last("id")).where("_n = 1").drop("_n")


def induced(nodes: DataFrame, edges: DataFrame, types: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Nodes of the types and the edges between them."""
    kept = nodes.where(F.col("type").isin(*types))
    return kept, valid_edges(kept, edges)


def type_counts(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("type").agg(F.count("*").alias("n"))


def isolated(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(type, n): nodes at no end of any edge."""
    ends = edges.select(F.col("source").alias("id")).union(edges.select("target")).distinct()
    return type_counts(nodes.join(ends, "id", "left_anti"))


def outside_tabs(nodes: DataFrame, tab_nodes: DataFrame) -> DataFrame:
    """(type, n): nodes in no tab."""
    return type_counts(nodes.join(tab_nodes.select("id").distinct(), "id", "left_anti"))


def out_degree(nodes: DataFrame, edges: DataFrame, types: Sequence[str], hidden: DataFrame) -> DataFrame:
    """(id, n): edges from a node of a visible type to one that is not in hidden(id)."""
    shown = nodes.where(F.col("type").isin(*types)).select("id")
    seen = edges.join(shown.withColumnRenamed("id", "source"), "source", "left_semi")
    seen = seen.join(shown.join(hidden.select("id"), "id", "left_anti").withColumnRenamed("id", "target"), "target", "left_semi")
    return seen.groupBy(F.col("source").alias("id")).agg(F.count("*").alias("n"))


def edge_ids(edges: DataFrame, keys: Sequence[str] = ("source", "target", "type"), order: Sequence[str] = ("ord",)) -> DataFrame:
    """edges with a stable id: a content hash, and ``_n`` from the second occurrence on."""
    at = F.row_number().over(W.partitionBy(*keys).orderBy(*order)) - 1
    base = F.substring(F.sha2(F.concat_ws("␟", *keys), 256), 1, 32)
    return edges.withColumn("occurrence", at).withColumn("id", F.when(F.col("occurrence") == 0, base).otherwise(F.concat(base, F.lit("_"), F.col("occurrence"))))


def usages(nodes: DataFrame, edges: DataFrame, ids: DataFrame | None = None, named: Callable[[str], Column] = F.col) -> DataFrame:
    """(id, file, callers): distinct direct callers of each node by the caller's file, most first.

    Self-loops and empty sources do not count. A caller without a file, or
    that is no node, is a group of its own, named ``#`` and its id. Where ids
    are numbers, ``named`` gives the name of a column of them.
    """
    some = F.col("source") != F.col("target")
    some = some & (F.col("source") != "") if dict(edges.dtypes)["source"] == "string" else some
    calls = edges.where(some).select(F.col("target").alias("id"), "source").distinct()
    calls = calls.join((nodes if ids is None else ids).select("id").distinct().hint("shuffle_hash"), "id", "left_semi")
    files = nodes.select(F.col("id").alias("source"), F.nullif("file", F.lit("")).alias("file")).dropDuplicates(["source"])
    met = calls.join(files.hint("shuffle_hash"), "source", "left").select("id", F.coalesce("file", F.concat(F.lit("#"), named("source"))).alias("file"))
    counted = met.groupBy("id", "file").agg(F.count("*").alias("callers")).withColumn("id", named("id"))
    return counted.orderBy("id", F.desc("callers"), F.col("file").startswith("#"), "file")


def usage_list(nodes: DataFrame, edges: DataFrame, ids: DataFrame | None = None, named: Callable[[str], Column] = F.col) -> DataFrame:
    """(id, file, callers, source, label, type, edge_labels, edge_types): each direct caller of each node, in its file.

    file and callers are those of usages, by which the rows can be ordered. The
    distinct labels and types of a caller's edges are joined by ``, `` in the
    order of the edges (ord); empty ones are left out. A caller that is no node
    is labelled by its id, of unknown type. Where ids are numbers, ``named``
    gives the name of a column of them.

    Edges meet their callers and then their targets, in joins that hold the
    nodes and let the edges pass unsorted. One sort then serves both windows,
    as a caller lies in one file.
    """
    some = F.col("source") != F.col("target")
    some = some & (F.col("source") != "") if dict(edges.dtypes)["source"] == "string" else some
    known = nodes.select(F.col("id").alias("source"), F.nullif("file", F.lit("")).alias("_file"), F.col("label").alias("_label"), F.col("type").alias("_type")).dropDuplicates(["source"])
    asked = (nodes if ids is None else ids).select(F.col("id").alias("target")).distinct()
    calls = edges.where(some).select("source", "target", "ord", F.coalesce("label", F.lit("")).alias("label"), F.coalesce("type", F.lit("")).alias("type"))
    # No semi-join: it would be moved ahead, and the rows dealt out by target twice.
    calls = calls.join(known.hint("shuffle_hash"), "source", "left").join(asked.hint("shuffle_hash"), "target")
    placed = calls.withColumn("file", F.coalesce("_file", F.concat(F.lit("#"), named("source"))))
    first = W.partitionBy("target", "file", "source").orderBy("ord", "label", "type")
    whole = first.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    each = placed.select("*", F.row_number().over(first).alias("_n"), F.collect_list("label").over(whole).alias("_labels"), F.collect_list("type").over(whole).alias("_types")).where("_n = 1")
    met = each.withColumn("callers", F.count("*").over(W.partitionBy("target", "file")))
    joined = lambda c: F.array_join(F.array_distinct(F.array_remove(c, "")), ", ")
    return met.select(named("target").alias("id"), "file", "callers", named("source").alias("source"), F.coalesce("_label", named("source")).alias("label"), F.coalesce("_type", F.lit("unknown")).alias("type"), joined("_labels").alias("edge_labels"), joined("_types").alias("edge_types"))


def focal(nodes: DataFrame, id: str | None = None, label: str | None = None) -> DataFrame:
    """The node of that id, else the first by ord whose label or uri equals the label in any case."""
    rank = F.when(F.col("id") == F.lit(id), 0)
    named = F.lower("label") == F.lit((label or "").lower())
    if "uri" in nodes.columns and label:
        named = named | (F.lower("uri") == label.lower())
    rank = rank if label is None else rank.when(named, 1)
    return nodes.withColumn("_r", rank).where("_r is not null").orderBy("_r", "ord").limit(1).drop("_r")


def tab_rollup(tab_nodes: DataFrame, seeds: DataFrame, nodes: DataFrame) -> DataFrame:
    """(tab_id, security, worst, smells, total): findings of the entry nodes; smells of all the tab's nodes.

    nodes has id, severity (null: no finding) and smell (boolean).
    """
    facts = nodes.select("id", "severity", "smell")
    worst = max_severity(F.coalesce("severity", F.lit("none")))
    entry = seeds.join(facts, "id", "left").groupBy("tab_id").agg(F.count("severity").alias("security"), worst.alias("worst"))
    smells = tab_nodes.join(facts, "id").groupBy("tab_id").agg(F.count_if("smell").alias("smells"))
    both = entry.join(smells, "tab_id", "left").withColumn("smells", F.coalesce("smells", F.lit(0)))
    return both.select("tab_id", "security", "worst", "smells", (F.col("security") + F.col("smells")).alias("total"))


#: Actors of a sequence from left to right.
# The order of the types of actors.
ACTOR_RANKS = {t: n for n, t in enumerate("route middleware controller action validation_request action_class service model event job command channel schedule view mail notification enum interface trait abstract_class service_provider ai_agent ai_tool".split())}


def type_rank(kind: Column, ranks: dict[str, int] = ACTOR_RANKS) -> Column:
    """Place of a node type among the actors; an action stands as its controller, an unknown type last (99)."""
    plain = F.when(kind == "action", "controller").otherwise(kind) if "controller" in ranks else kind
    return lookup(plain, {k: str(v) for k, v in ranks.items()}, "99").cast("int")


def actor_order(nodes: DataFrame, ranks: dict[str, int] = ACTOR_RANKS) -> DataFrame:
    """nodes with type_rank, ordered by it and then by id."""
    return nodes.withColumn("type_rank", type_rank(F.col("type"), ranks)).orderBy("type_rank", "id")


# Where the steps of a flow hold steps of their own. Flags count in the branches of their kind of step only.
FLAG_BRANCHES = {"then": "if", "else": "if", "body": "loop"}
CALL_BRANCHES = {"then": None, "else": None, "body": None}


def any_flag(steps: DataFrame, flag: str) -> DataFrame:
    """(node_id, flag) over flattened steps(node_id, path, ...): whether any step of a node has the flag."""
    return steps.groupBy("node_id").agg(F.bool_or(F.coalesce(flag, F.lit(False))).alias(flag))


def walk_steps(trees: DataFrame, branches: dict[str, str | None]) -> DataFrame:
    """(node_id, path, step): every step of trees(node_id, steps), variants that hold arrays of steps, to any depth.

    ``branches`` names the fields in which a step holds steps of its own, each
    with the type of step in which it counts, or None for any. path tells the
    place, as ``0.then.2``. Each level is one pass over the steps that have
    some below them. A tree that is null or no array has no steps.
    """
    inner = lambda name: F.try_variant_get("step", f"$.{name}", "array<variant>")
    counts = lambda kind: F.lit(True) if kind is None else F.try_variant_get("step", "$.type", "string") == kind
    level = trees.select("node_id", F.posexplode(F.try_variant_get("steps", "$", "array<variant>")).alias("_n", "step"))
    level = stored(level.select("node_id", F.col("_n").cast("string").alias("path"), "step"))
    levels = [level]
    while branches:
        below = F.array_compact(F.array(*[F.when(counts(kind) & inner(name).isNotNull(), F.struct(F.lit(name).alias("name"), inner(name).alias("steps"))) for name, kind in branches.items()]))
        each = level.select("node_id", "path", F.explode(below).alias("_b")).select("node_id", "path", "_b.name", F.posexplode("_b.steps").alias("_n", "step"))
        level = stored(each.select("node_id", F.concat_ws(".", "path", "name", F.col("_n").cast("string")).alias("path"), "step"))
        if level.isEmpty():
            break
        levels.append(level)
    return reduce(DataFrame.union, levels)


def any_flag_in_trees(trees: DataFrame, flag: str, branches: dict[str, str | None] = FLAG_BRANCHES) -> DataFrame:
    """(node_id, flag): whether any step of trees(node_id, steps) has the flag, however deep; a node without steps has none."""
    seen = walk_steps(trees, branches).select("node_id", F.coalesce(F.try_variant_get("step", f"$.{flag}", "boolean"), F.lit(False)).alias("_on"))
    found = seen.groupBy("node_id").agg(F.bool_or("_on").alias("_on"))
    return trees.select("node_id").distinct().join(found, "node_id", "left").select("node_id", F.coalesce("_on", F.lit(False)).alias(flag))


def calls_in_trees(trees: DataFrame, field: str, branches: dict[str, str | None] = CALL_BRANCHES) -> DataFrame:
    """(node_id, call): the distinct entries, as JSON, of a list field over all steps of trees(node_id, steps); the order of an entry's keys does not count."""
    steps = walk_steps(trees, branches)
    each = steps.select("node_id", F.explode(F.try_variant_get("step", f"$.{field}", "array<variant>")).alias("_call"))
    return each.select("node_id", F.to_json("_call").alias("call")).distinct()


def flatten_calls(steps: DataFrame, field: str) -> DataFrame:
    """(node_id, fields...): the distinct entries of an array of structs over all steps of a node."""
    return steps.select("node_id", F.explode(field).alias("_c")).select("node_id", "_c.*").distinct()


def tab_list(manifest: DataFrame, mode: str, query: str | None = None, verbs: Sequence[str] = ()) -> DataFrame:
    """Tabs by substring of their label and by verb: ``risk`` keeps those above none, most severe first; ``recent`` the new and changed."""
    out = manifest if not query else manifest.where(F.lower("label").contains(query.lower()))
    out = out.where(F.col("verb").isin(*verbs)) if verbs else out
    if mode == "recent":
        return out.where(F.col("status").isin("new", "changed")).orderBy("status", "tab_id")
    rank = severity_rank(F.coalesce("risk_level", F.lit("none")))
    return out.withColumn("severity", rank).where("severity > 0").orderBy(F.desc("severity"), "tab_id")


def refine_types(nodes: DataFrame, facades: DataFrame, validators: DataFrame, roots: Sequence[str], default: str = "service") -> DataFrame:
    """nodes(id, fqcn, type, file) where a node of the default type may turn out to be of another.

    In this order: ``facade`` if facades(fqcn) has its class, else
    ``validation_request`` if validators(file) has its file, else
    ``action_class`` if its file lies under one of the roots.
    """
    plain = F.col("type") == default
    known = facades.select(F.col("fqcn").alias("_facade")).distinct()
    checked = validators.select(F.col("file").alias("_checked")).distinct()
    out = nodes.join(known, plain & (F.col("fqcn") == F.col("_facade")), "left").join(checked, plain & (F.col("file") == F.col("_checked")), "left")
    inside = reduce(lambda a, b: a | b, [F.col("file").startswith(r.rstrip("/") + "/") for r in roots], F.lit(False))
    kind = F.when(F.col("_facade").isNotNull(), "facade").when(F.col("_checked").isNotNull(), "validation_request").when(F.coalesce(inside, F.lit(False)), "action_class").otherwise(default)
    return out.withColumn("type", F.when(plain, kind).otherwise(F.col("type"))).drop("_facade", "_checked")


def stated(table: DataFrame, settings: Sequence[str]) -> DataFrame:
    """Rows that state some setting: not null, not false, not an empty string or array."""
    keep = F.lit(False)
    kinds = dict(table.dtypes)
    for c in settings:
        col = F.col(c)
        said = col if kinds[c] == "boolean" else (F.size(col) > 0) if kinds[c].startswith("array") else (F.length(col) > 0) if kinds[c] == "string" else col.isNotNull()
        keep = keep | F.coalesce(said, F.lit(False))
    return table.where(keep)
