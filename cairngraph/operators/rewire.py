"""Joins that assemble and rewire a graph from fact tables."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .closure import guard_names


def resolve_alias(names: DataFrame, aliases: DataFrame, col: str = "name") -> DataFrame:
    """names with ``resolved``: the part before the first ``:`` replaced by its aliases(alias, target), parameters kept."""
    head = F.substring_index(col, ":", 1)
    rest = F.when(F.col(col).contains(":"), F.concat(F.lit(":"), F.expr(f"substr({col}, instr({col}, ':') + 1)"))).otherwise("")
    return names.withColumn("_head", head).join(aliases.select(F.col("alias").alias("_head"), F.col("target").alias("_to")), "_head", "left").withColumn("resolved", F.concat(F.coalesce("_to", "_head"), rest)).drop("_head", "_to")


def rewire_bindings(call_edges: DataFrame, classes: DataFrame, bindings: DataFrame) -> DataFrame:
    """(source, target, type): for abstract callees, abstract to provider and abstract to concrete, each once."""
    abstract = classes.where("kind in ('interface', 'abstract')").select(F.col("fqcn").alias("abstract"))
    called = call_edges.select(F.col("callee").alias("abstract")).distinct().join(abstract, "abstract", "left_semi")
    bound = called.join(bindings, "abstract")
    to_provider = bound.where("provider is not null").select(F.col("abstract").alias("source"), F.col("provider").alias("target"), F.lit("bound-in").alias("type"))
    to_concrete = bound.where("concrete is not null and concrete <> abstract").select("abstract", "concrete", F.lit("bound-to"))
    return to_provider.union(to_concrete).distinct()


def resolve_facades(facades: DataFrame, bindings: DataFrame) -> DataFrame:
    """(facade, concrete): the facade's own concrete, else that bound to its accessor."""
    bound = bindings.groupBy(F.col("abstract").alias("accessor")).agg(F.min("concrete").alias("_bound"))
    return facades.join(bound, "accessor", "left").select("facade", F.coalesce("concrete", "_bound").alias("concrete"))


def priority_resolve(keys: DataFrame, *sources: DataFrame) -> DataFrame:
    """(key, value, rank) from sources(key, value), earlier sources first; never the key itself.

    Entries of the first source for unknown keys are still given.
    """
    ranked = None
    for n, s in enumerate(sources):
        part = s.select("key", "value", F.lit(n).alias("rank"))
        part = part if n == 0 else part.join(keys.select("key").distinct(), "key", "left_semi")
        ranked = part if ranked is None else ranked.union(part)
    best = F.min(F.struct("rank", "value")).alias("b")
    return ranked.where("value is not null and value <> key").groupBy("key").agg(best).select("key", "b.value", "b.rank")


def template_match(left: DataFrame, right: DataFrame, sep: str = ".") -> DataFrame:
    """(left, right): templates that agree once every segment that is wholly a ``{name}`` is ``{}``; the first right one (ord) counts."""
    norm = lambda c: F.array_join(F.transform(F.split(c, re.escape(sep)), lambda x: F.when(x.startswith("{") & x.endswith("}"), "{}").otherwise(x)), sep)
    first = right.groupBy(norm("template").alias("_t")).agg(F.min_by("template", "ord").alias("right"))
    return left.select(F.col("template").alias("left"), norm("template").alias("_t")).join(first, "_t").select("left", "right")


def two_key_link(left: DataFrame, right: DataFrame, first: str, second: str, value: str) -> DataFrame:
    """left with ``value`` of the right row that agrees on the first key, else on the second."""
    a = right.where(F.col(first).isNotNull()).groupBy(first).agg(F.min(value).alias("_a"))
    b = right.where(F.col(second).isNotNull()).groupBy(second).agg(F.min(value).alias("_b"))
    return left.join(a, first, "left").join(b, second, "left").withColumn(value, F.coalesce("_a", "_b")).drop("_a", "_b")


def provides_edges(providers: DataFrame, nodes: DataFrame) -> DataFrame:
    """(source, target): every node of a provided class to its deferred provider."""
    each = providers.where("deferred").select(F.col("fqcn").alias("target"), F.explode("provides").alias("fqcn"))
    return each.join(nodes.select("fqcn", F.col("id").alias("source")), "fqcn").select("source", "target").distinct()


def er_graph(models: DataFrame, stats: DataFrame | None = None, schemas: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Entity nodes (id, external, stats, schema) and edges (source, target, type) of models(fqcn, table, relationships array<struct<type, related>>).

    A related entity is resolved by its full name; one written without a
    namespace else by its short name, in any case, if that is unique; the rest
    are external placeholders. stats(table, ...) and schemas(table, ...) are
    stamped as structs on the entities of their table; without one the column
    is null.
    """
    short = F.lower(F.substring_index("fqcn", "\\", -1))
    unique = models.groupBy(short.alias("_short")).agg(F.min("fqcn").alias("_by_short"), F.count("*").alias("_n")).where("_n = 1").drop("_n")
    rel = models.select(F.col("fqcn").alias("source"), F.explode("relationships").alias("r")).select("source", "r.type", F.regexp_replace("r.related", r"^\\+", "").alias("related")).where("related <> ''")
    full = models.select(F.col("fqcn").alias("related"), F.col("fqcn").alias("_full"))
    bare = F.when(~F.col("related").contains("\\"), F.lower("related"))
    rel = rel.join(full, "related", "left").withColumn("_short", bare).join(unique, "_short", "left")
    edges = rel.select("source", F.coalesce("_full", "_by_short", "related").alias("target"), "type").distinct()
    ids = models.select(F.col("fqcn").alias("id"), "table", F.lit(False).alias("external"))
    for name, facts in (("stats", stats), ("schema", schemas)):
        given = facts.select("table", F.struct(*[c for c in facts.columns if c != "table"]).alias(name)) if facts is not None else None
        ids = ids.withColumn(name, F.lit(None)) if given is None else ids.join(given, "table", "left")
    missing = edges.select(F.col("target").alias("id")).distinct().join(ids.select("id"), "id", "left_anti").withColumn("external", F.lit(True))
    return ids.unionByName(missing, allowMissingColumns=True).drop("table"), edges


def stamp(nodes: DataFrame, facts: DataFrame, key: str, cols: Sequence[str]) -> DataFrame:
    """nodes with the facts' columns where the key agrees; all nodes are kept."""
    return nodes.join(facts.select(key, *cols), key, "left")


def range_findings(findings: DataFrame, spans: DataFrame) -> DataFrame:
    """findings(file, line, ...) by the spans(file, id, first, last) that hold their line; without a line, by every span of the file.

    A span lies in one or two bins of the least power of two that is no less
    than its length, and a finding in one bin of each size that spans have. So
    a finding meets the spans near its line only, however many a file has.
    """
    length = F.col("last") - F.col("first") + 1
    sized = spans.where("first <= last").withColumn("_size", F.ceil(F.log2(length.cast("double"))).cast("int"))
    width = F.expr("shiftleft(1L, _size)")
    binned = sized.withColumn("_bin", F.explode(F.sequence(F.floor(F.col("first") / width), F.floor(F.col("last") / width))))
    sizes = [r[0] for r in sized.select("_size").distinct().collect()]  # at most one for each bit of a line number
    placed = findings.where("line is not null").withColumn("_size", F.explode(F.array(*map(F.lit, sizes)).cast("array<int>"))).withColumn("_bin", F.floor(F.col("line") / width))
    near = placed.join(binned, ["file", "_size", "_bin"]).where(F.col("line").between(F.col("first"), F.col("last"))).drop("_size", "_bin")
    return near.unionByName(findings.where("line is null").join(spans, "file").select(*near.columns))


def inherited(classes: DataFrame, reached: DataFrame) -> DataFrame:
    """(id): what classes(id, parent, interfaces, traits) that are reached(id) extend, implement or use; ids are names or numbers."""
    near = classes.join(reached.select("id").distinct(), "id", "left_semi")
    each = near.select(F.explode(F.concat(F.array("parent"), F.coalesce("interfaces", F.array()), F.coalesce("traits", F.array()))).alias("id"))
    return each.where(F.col("id").isNotNull() & (F.col("id").cast("string") != "")).distinct()


def evidence(unreached: DataFrame, bound: DataFrame, facades: DataFrame, inherited: DataFrame, configured: DataFrame, mentioned: DataFrame) -> DataFrame:
    """(id, file, evidence): for unreached(id, file), what speaks for it though nothing reaches it.

    In this order: facade if facades(id) names it, else bound if bound(id)
    does; configured if configured(id, file) names it from another file;
    inherited if inherited(id) does; mentioned if mentioned(id, file) names it
    from another file. All five meet the unreached in one join that holds the
    unreached only and lets the others, which may be many times more, pass by
    unsorted.
    """
    facts = None
    for n, (name, table) in enumerate({"facade": facades, "bound": bound, "configured": configured, "inherited": inherited, "mentioned": mentioned}.items()):
        filed = name in ("configured", "mentioned")
        part = table.select("id", F.lit(n).alias("_n"), (F.col("file") if filed else F.lit(None).cast("string")).alias("_f"), F.lit(filed).alias("_filed"))
        facts = part if facts is None else facts.union(part)
    hits = unreached.select("id", "file").hint("shuffle_hash").join(facts, "id").where("not _filed or not (_f <=> file)")
    on = {name: F.bool_or(F.col("_n") == n).alias(name) for n, name in enumerate(("facade", "bound", "configured", "inherited", "mentioned"))}
    found = hits.groupBy("id").agg(*on.values()).withColumn("bound", F.expr("bound and not facade"))
    listed = found.select("id", F.array_compact(F.array(*[F.when(F.col(name), F.lit(name)) for name in on])).alias("_all"))
    return unreached.join(listed, "id", "left").select("id", "file", F.coalesce("_all", F.array().cast("array<string>")).alias("evidence"))


def first_existing(candidates: DataFrame, nodes: DataFrame) -> DataFrame:
    """(key, id): of candidates(key, ids array) the first that is a node."""
    each = candidates.select("key", F.posexplode("ids").alias("pos", "id")).join(nodes.select("id").distinct(), "id", "left_semi")
    return each.groupBy("key").agg(F.min_by("id", "pos").alias("id"))


def invoked(members: DataFrame, edges: DataFrame) -> DataFrame:
    """members(class, member) with ``invoked``: whether any edge targets class::member."""
    hit = edges.select(F.col("target").alias("_t")).distinct()
    return members.join(hit, F.concat_ws("::", "class", "member") == F.col("_t"), "left").select("class", "member", F.col("_t").isNotNull().alias("invoked"))


def group_regions(job_groups: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, region, kind, pos) per member node and region, once; only chains carry a position."""
    met = job_groups.join(nodes.select(F.col("fqcn").alias("job"), F.col("id").alias("node")), "job")
    pos = F.when(F.col("kind") == "chain", F.col("pos"))
    return met.groupBy(F.col("node").alias("id"), F.col("id").alias("region"), "kind").agg(F.min(pos).alias("pos"))


def span_regions(call_edges: DataFrame, openers: DataFrame) -> DataFrame:
    """(id, span, kind): spans of each callee, and of the opener itself; rollback wins over transaction."""
    inside = call_edges.where("span is not null and (in_transaction or in_rollback)").select(F.col("callee").alias("id"), "span", F.coalesce("in_rollback", F.lit(False)).alias("r"))
    rows = inside.union(openers.select("id", "span", F.lit(False)))
    return rows.groupBy("id", "span").agg(F.when(F.bool_or("r"), "rollback").otherwise("transaction").alias("kind"))


def assemble_calls(call_edges: DataFrame, listener_edges: DataFrame, kind: str = "action") -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of call_edges(caller, callee, callee_type): ``kind-to-type``; listener edges are turned to event-to-listener."""
    calls = call_edges.select(F.col("caller").alias("source"), F.col("callee").alias("target"), F.concat(F.lit(f"{kind}-to-"), "callee_type").alias("type"))
    heard = listener_edges.select(F.col("event").alias("source"), F.col("listener").alias("target"), F.lit("event-to-listener").alias("type"))
    edges = calls.union(heard)
    ends = calls.select(F.col("source").alias("id"), F.lit(kind).alias("type")).union(call_edges.select("callee", "callee_type"))
    ends = ends.union(heard.select("source", F.lit("event"))).union(heard.select("target", F.lit("listener")))
    return ends.groupBy("id").agg(F.min("type").alias("type")), edges


def assemble_routes(routes: DataFrame, guards: DataFrame, groups: DataFrame, aliases: DataFrame) -> DataFrame:
    """(source, target, type) of routes(id, controller, action, middlewares) and guards(controller, name, only, except).

    A controller's guard applies to a route whose action is in ``only`` (null:
    any) and not in ``except`` (null: none). Guards are resolved through
    groups(group, pos, member) and aliases(alias, target), what is written
    being kept. Routes without a controller, or to a closure, lead to none.
    """
    named = routes.where("controller <> '' and controller <> 'Closure'")
    to_controller = named.select(F.col("id").alias("source"), F.col("controller").alias("target"), F.lit("route-to-controller").alias("type"))
    to_action = named.where("action <> ''").select("controller", F.concat_ws("::", "controller", "action"), F.lit("controller-to-action"))
    own = routes.select(F.col("id").alias("owner"), F.posexplode("middlewares").alias("pos", "name"))
    applies = (F.col("only").isNull() | F.array_contains("only", F.col("action"))) & ~F.coalesce(F.array_contains("except", F.col("action")), F.lit(False))
    given = routes.join(guards, "controller").where(applies).select("id", F.lit(1 << 20), "name")
    guarded = guard_names(own.select("owner", "pos", "name").union(given), groups, aliases)
    return to_controller.union(to_action).union(guarded.select("owner", "name", F.lit("route-to-guard"))).distinct()


def edges_from(table: DataFrame, spec: Sequence[tuple[Column, Column, str]]) -> DataFrame:
    """(source, target, type) by a list of (source column, target column, type); rows with a null end give none."""
    out = None
    for source, target, kind in spec:
        part = table.select(source.alias("source"), target.alias("target"), F.lit(kind).alias("type")).where("source is not null and target is not null").distinct()
        out = part if out is None else out.union(part)
    return out


def unwired(agents: DataFrame) -> DataFrame:
    """(fqcn, declared): agents that declare tools but not the support for them."""
    return agents.where((F.size("tools") > 0) & ~F.coalesce("has_tools", F.lit(False))).select("fqcn", F.array_sort("tools").alias("declared"))


def dependency_edges(deps: DataFrame, classes: DataFrame, edges: DataFrame, kind: str) -> DataFrame:
    """(source, target, type): deps(source, target) on declared classes, without pairs that have an edge."""
    known = deps.join(classes.select(F.col("fqcn").alias("target")).distinct(), "target", "left_semi").select("source", "target").distinct()
    return known.join(edges.select("source", "target"), ["source", "target"], "left_anti").withColumn("type", F.lit(kind))


def supplement(edges: DataFrame, classes: DataFrame, nodes: DataFrame, kinds: Sequence[str] = ("enum", "trait", "abstract")) -> DataFrame:
    """(id, kind): referenced declarations of the kinds that are no nodes yet."""
    named = edges.select(F.col("source").alias("id")).union(edges.select("target")).distinct()
    return named.join(classes.where(F.col("kind").isin(*kinds)).select(F.col("fqcn").alias("id"), "kind"), "id").join(nodes.select("id"), "id", "left_anti")


def forward_fill(df: DataFrame, part: Sequence[str], order: str, col: str) -> DataFrame:
    """df with ``filled``: the last value of col that is set, in order."""
    return df.withColumn("filled", F.last(col, ignorenulls=True).over(W.partitionBy(*part).orderBy(order).rowsBetween(W.unboundedPreceding, 0)))
