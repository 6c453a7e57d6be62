"""Snapshot differences and incremental maintenance."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..lineage import stored


def snapshot_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, change) of two snapshots(path, hash): added, modified or deleted."""
    both = old.select("path", F.col("hash").alias("_old")).join(new.select("path", F.col("hash").alias("_new")), "path", "full")
    change = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "deleted").when(F.col("_old") != F.col("_new"), "modified")
    return both.select("path", change.alias("change")).where("change is not null")


def edge_delta(old: DataFrame, new: DataFrame, keys: Sequence[str] = ("source", "target", "type")) -> DataFrame:
    """(keys..., occurrence, side): edges, repeated ones by their number, on one side only.

    Equal edges are counted and not numbered one by one, so an edge repeated
    without end is one row until the numbers on one side only are given. Both
    sides are counted in one pass; an edge with a null key equals none of the
    other side.
    """
    sides = old.select(*keys, F.lit(False).alias("_new")).union(new.select(*keys, F.lit(True).alias("_new")))
    apart = F.when(reduce(lambda a, b: a | b, [F.col(f"`{k}`").isNull() for k in keys]), F.col("_new")).alias("_apart")
    both = sides.groupBy(*keys, apart).agg(F.count_if(~F.col("_new")).alias("_o"), F.count_if("_new").alias("_n")).where("_o <> _n")
    numbers = F.sequence(F.least("_o", "_n"), F.greatest("_o", "_n") - 1)
    return both.select(*keys, F.explode(numbers).alias("occurrence"), F.when(F.col("_o") < F.col("_n"), "added").otherwise("removed").alias("side"))


EDGE = ("source", "target", "type")


def owned_edges(nodes: DataFrame, edges: DataFrame, files: DataFrame) -> DataFrame:
    """Edges whose source node lies in one of files(file)."""
    owners = nodes.join(files.select("file").distinct(), "file", "left_semi").select(F.col("id").alias("source")).distinct()
    return edges.join(owners, "source", "left_semi").select(*edges.columns)


def owned_equal(old_nodes: DataFrame, old_edges: DataFrame, new_nodes: DataFrame, new_edges: DataFrame, files: DataFrame, keys: Sequence[str] = EDGE) -> DataFrame:
    """One row (equal): whether files(file) own the same edges, as often, in both builds, which are counted against each other in one pass."""
    owned = lambda n, e, k: owned_edges(n, e, files).select(*keys, F.lit(k).alias("_k"))
    odd = owned(old_nodes, old_edges, 1).union(owned(new_nodes, new_edges, -1)).groupBy(*keys).agg(F.sum("_k").alias("_k")).where("_k <> 0")
    return odd.agg((F.count("*") == 0).alias("equal"))


def unbacked(providers: DataFrame) -> DataFrame:
    """providers with ``missing``: promised keys that are not registered.

    None if the provider is not deferred, promises dynamically or is not seen
    to register anything.
    """
    silent = ~F.col("deferred") | F.col("provides_dynamic") | (F.size("binding_keys") <= 0)
    return providers.withColumn("missing", F.when(silent, F.array().cast("array<string>")).otherwise(F.array_sort(F.array_except("provides", "binding_keys"))))


def provider_defects(providers: DataFrame) -> DataFrame:
    """providers with ``defect``: never-boots, else unbacked-provides, else legacy-defer (the old flag on an eager provider), else null."""
    never = F.col("deferred") & (F.size("provides") <= 0) & (F.size("when_events") <= 0) & ~F.col("provides_dynamic")
    old_flag = F.col("legacy_defer") & ~F.col("deferred")
    return unbacked(providers).withColumn("defect", F.when(never, "never-boots").when(F.size("missing") > 0, "unbacked-provides").when(old_flag, "legacy-defer"))


def tab_status(new: DataFrame, prev: DataFrame | None = None) -> DataFrame:
    """(tab_id, status) of a manifest against the one before: new, changed or unchanged by nodes:edges:risk.

    Missing counts are 0 and a missing risk is none. Without a manifest before,
    and for tabs without an id, everything is unchanged.
    """
    mark = F.concat_ws(":", F.coalesce("node_count", F.lit(0)), F.coalesce("edge_count", F.lit(0)), F.coalesce("risk_level", F.lit("none")))
    if prev is None:
        return new.select("tab_id", F.lit("unchanged").alias("status"))
    both = new.select("tab_id", mark.alias("_n")).join(prev.select("tab_id", mark.alias("_p")), "tab_id", "left")
    status = F.when(F.col("tab_id").isNull(), "unchanged").when(F.col("_p").isNull(), "new").when(F.col("_n") != F.col("_p"), "changed")
    return both.select("tab_id", status.otherwise("unchanged").alias("status"))


def count_changes(base: DataFrame, head: DataFrame) -> DataFrame:
    """(scenario, key, base, head): counts that differ or are on one side only."""
    both = base.select("scenario", "key", F.col("value").alias("base")).join(head.select("scenario", "key", F.col("value").alias("head")), ["scenario", "key"], "full")
    return both.where(~F.col("base").eqNullSafe(F.col("head")))


def exact(*cols: str) -> Column:
    """One text that only equal values of all columns share: each with its length before it, nulls apart."""
    one = lambda c: F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string"), F.lit(";")), F.lit("-;"))
    return F.concat(*[one(F.col(c)) for c in cols])


def _numbered(edges: DataFrame, keys: Sequence[str], fields: Sequence[str] = ()) -> DataFrame:
    """edges with ``occurrence``, the number of the edge among those of equal keys, by their fields; those of equal fields are interchangeable."""
    return edges.withColumn("occurrence", F.row_number().over(W.partitionBy(*keys).orderBy(*keys, *fields)) - 1)


def graph_signature(nodes: DataFrame, edges: DataFrame, fields: Sequence[str] = ("type", "label"), keys: Sequence[str] = EDGE, edge_fields: Sequence[str] = ("label",)) -> DataFrame:
    """(kind, id, signature): hashes of what nodes and edges say.

    Edges are named by their keys and occurrence, so the order of two builds
    does not matter; their signature is of their keys and ``edge_fields``. No
    two different values share a text that is hashed or named.
    """
    n = nodes.select(F.lit("node").alias("kind"), "id", F.md5(exact(*fields)).alias("signature"))
    name = F.concat(exact(*keys), F.lit("#"), F.col("occurrence").cast("string"))
    return n.union(_numbered(edges, keys, edge_fields).select(F.lit("edge"), name, F.md5(exact(*keys, *edge_fields))))


def _met(old: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """(keys..., occurrence, _a, _b): the edges of two builds by their keys and the number among equal ones; _a and _b are structs of new's other columns, null on the side that lacks the edge.

    Both builds are dealt out once, by their keys, for the numbers and for the meeting.
    """
    cols = [F.col(f"`{c}`") for c in new.columns if c not in keys]
    row = F.struct(F.lit(True).alias("_held"), *cols).alias("_row")
    both = old.select(*keys, F.lit(False).alias("_new"), row).union(new.select(*keys, F.lit(True).alias("_new"), row)).repartition(*keys)
    at = W.partitionBy(*keys, "_new").orderBy(*[F.col("_row")[c] for c in order] or ["_new"])
    side = lambda new, to: F.first(F.when(F.col("_new") == new, F.col("_row")), ignorenulls=True).alias(to)
    return both.withColumn("occurrence", F.row_number().over(at) - 1).groupBy(*keys, "occurrence").agg(side(False, "_a"), side(True, "_b"))


def signature_pairs(old_nodes: DataFrame, old_edges: DataFrame, new_nodes: DataFrame, new_edges: DataFrame, fields: Sequence[str] = ("type", "label"), keys: Sequence[str] = EDGE, edge_fields: Sequence[str] = ("label",), name: Callable[[Column], Column] = lambda c: c) -> DataFrame:
    """(kind, id, old, new): each element of two graphs with its signatures, as graph_signature gives them, null where it is in one alone.

    Elements meet by their own keys, before they are named and hashed. Where
    ids, sources and targets are numbers, ``name`` gives their texts.
    """
    row = F.struct(F.lit(True).alias("_held"), *fields)
    a, b = old_nodes.select("id", row.alias("_a")), new_nodes.select(F.col("id").alias("_id"), row.alias("_b"))
    n = a.join(b, F.col("id").eqNullSafe(F.col("_id")), "full").select(F.coalesce("id", "_id").alias("id"), "_a", "_b")
    said = lambda side: F.when(F.col(side).isNotNull(), F.md5(exact(*[f"{side}.{c}" for c in fields])))
    n = n.select(F.lit("node").alias("kind"), name(F.col("id")).alias("id"), said("_a").alias("old"), said("_b").alias("new"))
    met = _met(old_edges.select(*keys, *edge_fields), new_edges.select(*keys, *edge_fields), keys, edge_fields)
    met = met.select(*[(name(F.col(c)) if c in ("source", "target") else F.col(c)).alias(c) for c in keys], "occurrence", "_a", "_b").withColumn("_keys", exact(*keys))
    said = lambda side: F.when(F.col(side).isNotNull(), F.md5(F.concat("_keys", exact(*[f"{side}.{c}" for c in edge_fields]))))
    e = met.select(F.lit("edge"), F.concat("_keys", F.lit("#"), F.col("occurrence").cast("string")), said("_a"), said("_b"))
    return n.union(e)


def pair_trees(pairs: DataFrame, digits: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Two signature trees (level, kind, range, n, total) of signature_pairs, and (kind, range, odd): how many elements differ in each of the finest ranges.

    The pairs are read once and summed by their finest ranges; each coarser
    level is summed from the next finer one. A signature adds a 64-bit hash to
    the total, in two halves whose sums no range can overflow.
    """
    odd = ~F.col("old").eqNullSafe(F.col("new"))
    sums = [F.count_if(odd).alias("odd")]
    for side in ("old", "new"):
        hashed = F.when(F.col(side).isNotNull(), F.xxhash64("kind", "id", side))
        sums += [F.count(side).alias(f"_n_{side}"), F.sum(F.shiftrightunsigned(hashed, 32)).alias(f"_high_{side}"), F.sum(hashed.bitwiseAND(F.lit(2**32 - 1))).alias(f"_low_{side}")]
    finest = stored(pairs.groupBy("kind", id_range("id", digits).alias("range")).agg(*sums))
    trees = []
    for side in ("old", "new"):
        whole = lambda c: F.col(c).cast("decimal(20,0)")
        level = finest.where(f"_n_{side} > 0").select("kind", "range", F.col(f"_n_{side}").alias("n"), (whole(f"_high_{side}") * F.lit(2**32).cast("decimal(11,0)") + whole(f"_low_{side}")).cast("decimal(38,0)").alias("total"))
        tree = level.select(F.lit(digits).alias("level"), "*")
        for k in range(digits - 1, 0, -1):
            level = level.groupBy("kind", F.substring("range", 1, k).alias("range")).agg(F.sum("n").alias("n"), F.sum("total").cast("decimal(38,0)").alias("total"))
            tree = tree.union(level.select(F.lit(k).alias("level"), "*"))
        trees.append(tree)
    return trees[0], trees[1], finest.select("kind", "range", "odd")


def signature_tree(signed: DataFrame, digits: int) -> DataFrame:
    """(level, kind, range, n, total): sums of the signatures over ranges of ids, for each level of 1 to ``digits`` digits.

    A range is the first hexadecimal digits of the hash of the id. Equal ranges
    have equal n and total; different ones share them by chance alone. The
    finest level is summed first and each coarser one from the next finer one.
    """
    number = F.conv(F.substring(F.md5(exact("kind", "id", "signature")), 1, 15), 16, 10).cast("decimal(38,0)")
    out = level = None
    for k in range(digits, 0, -1):
        if level is None:
            level = stored(signed.groupBy("kind", id_range("id", k).alias("range")).agg(F.count("*").alias("n"), F.sum(number).alias("total")))
        else:
            level = level.groupBy("kind", F.substring("range", 1, k).alias("range")).agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
        part = level.select(F.lit(k).alias("level"), "kind", "range", "n", F.col("total").cast("decimal(38,0)").alias("total"))
        out = part if out is None else out.union(part)
    return out


def id_range(column: str, digits: int) -> Column:
    return F.substring(F.md5(column), 1, digits)


def tree_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """(kind, range): the finest ranges in which two signature trees of equal depth differ, found from the coarsest level down.

    Below a range that is equal in both nothing is compared.
    """
    digits = max(x.agg(F.max("level")).first()[0] or 0 for x in (a, b))
    odd = None
    for k in range(1, digits + 1):
        one, two = (x.where(F.col("level") == k).select("kind", "range", F.struct("n", "total").alias(side)) for x, side in ((a, "_a"), (b, "_b")))
        if odd is not None:
            above = lambda x: x.withColumn("_above", F.substring("range", 1, k - 1)).join(odd.select(F.col("kind"), F.col("range").alias("_above")), ["kind", "_above"], "left_semi").drop("_above")  # noqa: B023, E731
            one, two = above(one), above(two)
        odd = stored(one.join(two, ["kind", "range"], "full").where(~F.col("_a").eqNullSafe(F.col("_b"))).select("kind", "range"))
    return odd if odd is not None else a.select("kind", "range").limit(0)


def signature_diff(a: DataFrame, b: DataFrame, ranges: DataFrame | None = None, digits: int = 0) -> DataFrame:
    """(kind, id): elements of two signatures that differ or are on one side only; none means equal graphs.

    With ranges(kind, range) of so many digits, as tree_diff gives them, only
    the elements of those ranges are joined.
    """
    if ranges is not None:
        a, b = (x.withColumn("range", id_range("id", digits)).join(ranges, ["kind", "range"], "left_semi").drop("range") for x in (a, b))
    both = a.withColumnRenamed("signature", "_a").join(b.withColumnRenamed("signature", "_b"), ["kind", "id"], "full")
    return both.where(~F.col("_a").eqNullSafe(F.col("_b"))).select("kind", "id")


def line_delta(old: DataFrame, new: DataFrame) -> DataFrame:
    """(doc_id, added, removed): lines, repeated ones counted, of two versions(doc_id, text)."""
    lines = lambda df: df.select("doc_id", F.explode(F.split("text", "\n")).alias("line")).groupBy("doc_id", "line").agg(F.count("*").alias("n"))
    both = lines(old).withColumnRenamed("n", "o").join(lines(new).withColumnRenamed("n", "w"), ["doc_id", "line"], "full")
    gap = F.coalesce("w", F.lit(0)) - F.coalesce("o", F.lit(0))
    return both.groupBy("doc_id").agg(F.sum(F.greatest(gap, F.lit(0))).alias("added"), F.sum(F.greatest(-gap, F.lit(0))).alias("removed"))


def provenance(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, id, file): nodes by their file, edges by their source node's; '' where there is none."""
    n = nodes.select(F.lit("node").alias("kind"), "id", F.coalesce("file", F.lit("")).alias("file"))
    e = edges.select(F.concat_ws("|", "source", "target", "type").alias("id"), "source").join(nodes.select(F.col("id").alias("source"), "file"), "source", "left")
    return n.union(e.select(F.lit("edge"), "id", F.coalesce("file", F.lit(""))))


def dirty_set(old_nodes: DataFrame, new_nodes: DataFrame, delta: DataFrame, files: DataFrame) -> DataFrame:
    """(id): nodes of changed files(file) in either build and both ends of every edge in the delta."""
    owned = old_nodes.select("id", "file").union(new_nodes.select("id", "file")).join(files, "file", "left_semi").select("id")
    return owned.union(delta.select("source")).union(delta.select("target")).distinct()


def reconstruct(old_nodes: DataFrame, old_edges: DataFrame, new_nodes: DataFrame, new_edges: DataFrame, files: DataFrame, keys: Sequence[str] = EDGE) -> tuple[DataFrame, DataFrame]:
    """The new build's nodes(id, file, ...) and edges(keys..., ...), old rows being reused for all that is not dirty.

    Dirty are the nodes and edges of the changed files in either build, edges
    on one side only and the ends of those. Both builds' edges meet once, by
    their keys and numbers: an edge on one side only has no row to be taken in
    its place, so of the others only the owner of their source decides.
    """
    met = stored(_met(old_edges, new_edges, keys))
    dirty = dirty_set(old_nodes, new_nodes, met.where("_a is null or _b is null"), files)
    owned = old_nodes.select("id", "file").union(new_nodes.select("id", "file")).join(files.select("file").distinct(), "file", "left_semi")
    owners = owned.select(F.col("id").alias("source")).distinct().withColumn("_owned", F.lit(True))
    now = met.where("_b is not null").join(owners, "source", "left")
    rows = now.withColumn("_row", F.when(F.col("_owned").isNull() & F.col("_a").isNotNull(), F.col("_a")).otherwise(F.col("_b")))
    cols = [F.col(c) if c in keys else F.col(f"_row.`{c}`") for c in new_edges.columns]
    return _reuse(old_nodes, new_nodes, dirty, ["id"]), rows.select(*cols)


def _reuse(old: DataFrame, new: DataFrame, dirty: DataFrame, on: list[str]) -> DataFrame:
    """Rows of new, those of old in their place where the key is in both and not dirty."""
    cols = [c for c in new.columns if c not in on]
    was = old.join(dirty, on, "left_anti").select(*on, F.struct(*[F.col(f"`{c}`") for c in cols]).alias("_was"))
    met = new.select(*on, F.struct(*[F.col(f"`{c}`") for c in cols]).alias("_now")).join(was, on, "left")
    return met.select(*on, F.coalesce("_was", "_now").alias("_row")).select(*on, "_row.*").select(*new.columns)


def apply_partial(old_nodes: DataFrame, old_edges: DataFrame, partial_nodes: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The old graph with the nodes of changed files(file) replaced by those of the partial build, at their old ord.

    A node that the partial build no longer has is dropped. All edges are kept:
    this is only right where owned_equal holds, and then there is no new node.
    """
    owned = old_nodes.select("id", "file").union(partial_nodes.select("id", "file")).join(files, "file", "left_semi").select("id").distinct()
    kept = old_nodes.join(owned, "id", "left_anti")
    cols = [c for c in old_nodes.columns if c != "ord"]
    places = old_nodes.select("id", "ord").join(owned, "id", "left_semi")
    fresh = partial_nodes.select(*cols).join(places, "id")
    return kept.select(*old_nodes.columns).union(fresh.select(*old_nodes.columns)), old_edges


def scope_decision(diff: DataFrame, roots: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(by..., decision, files): full if the path set changed or a path lies outside the roots, else list.

    Without ``by`` there is one row, and none without a change; by projects,
    those without a change are not in diff and have no row.
    """
    outside = ~F.coalesce(F.greatest(*[(F.col("path").startswith(r.rstrip("/") + "/") | (F.col("path") == r.rstrip("/"))).cast("int") for r in roots], F.lit(0)), F.lit(0)).cast("boolean")
    facts = diff.groupBy(*by).agg(F.count("path").alias("n"), F.count_if((F.col("change") != "modified") | outside).alias("hard"))
    return facts.select(*by, F.when(F.col("n") == 0, "none").when(F.col("hard") > 0, "full").otherwise("list").alias("decision"), F.col("n").alias("files"))
