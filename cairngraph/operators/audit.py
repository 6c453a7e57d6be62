"""Rule-based audits of routes, schemas and declared relations."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import contains_any, glob_match, guard_match
from .closure import inherits_from

EXPOSURES = ("public", "guest", "authed", "admin")


def exposure(route_guards: DataFrame, routes: DataFrame, patterns: dict[str, Sequence[str]], parents: DataFrame | None = None, auth_bases: DataFrame | None = None) -> DataFrame:
    """(route, exposure): the strongest of admin > authed > guest > public among route_guards(route, guard), guards expanded before.

    A guard also counts as authed if its class is one of auth_bases(id) or
    reaches one over parents(child, parent).
    """
    guards = route_guards.select("route", "guard", F.regexp_replace(F.substring_index("guard", ":", 1), r"^\\+", "").alias("_class"))
    by_class = F.lit(False)
    if auth_bases is not None:
        known = auth_bases.select("id")
        if parents is not None:
            known = known.union(inherits_from(parents, auth_bases).where("inherits").select("id"))
        guards = guards.join(known.distinct().select(F.col("id").alias("_class"), F.lit(True).alias("_auth")), "_class", "left")
        by_class = F.coalesce("_auth", F.lit(False))
    rank = F.lit(0)
    for level in ("guest", "authed", "admin"):
        hit = guard_match(F.col("guard"), list(patterns.get(level, ())))
        rank = F.greatest(rank, F.when(hit | by_class if level == "authed" else hit, EXPOSURES.index(level)).otherwise(0))
    best = guards.groupBy("route").agg(F.max(rank).alias("_r"))
    return routes.select("route").distinct().join(best, "route", "left").select("route", F.get(F.array(*[F.lit(e) for e in EXPOSURES]), F.coalesce("_r", F.lit(0))).alias("exposure"))


def route_filter(nodes: DataFrame, exposure: str | None = None, risk: str | None = None, contains: str | None = None) -> DataFrame:
    """(id, method, uri, name, exposure, risk_level) of the route nodes that match every given filter.

    A route without the asked value does not match; of those shown a missing
    exposure is unknown, a missing risk none and a missing uri empty.
    """
    uri = F.coalesce("uri", F.lit(""))
    out = nodes.where("type = 'route'")
    out = out if exposure is None else out.where(F.col("exposure") == exposure)
    out = out if risk is None else out.where(F.col("risk_level") == risk)
    out = out if contains is None else out.where(uri.contains(contains))
    return out.select("id", "method", uri.alias("uri"), "name", F.coalesce("exposure", F.lit("unknown")).alias("exposure"), F.coalesce("risk_level", F.lit("none")).alias("risk_level"))


def missing_throttle(routes: DataFrame, route_guards: DataFrame, sensitive: Sequence[str]) -> DataFrame:
    """(route, severity): sensitive writes without a throttle guard or a throttle in code."""
    throttled = route_guards.where(guard_match(F.col("guard"), ["throttle"])).select("route")
    risky = routes.where(F.upper("method").isin("POST", "PUT", "PATCH") & contains_any(F.col("uri"), list(sensitive)) & ~F.coalesce("throttled_in_code", F.lit(False)))
    return risky.join(throttled, "route", "left_anti").select("route", F.lit("high").alias("severity"))


def public_write(routes: DataFrame, exposed: DataFrame, trusted: Sequence[str] = (), trusted_names: Sequence[str] = ()) -> DataFrame:
    """(route, severity): public writes that no glob of trusted addresses or names covers; DELETE is high, others medium.

    Addresses and their globs agree with or without leading slashes.
    """
    globs = [p.lstrip("/") for p in trusted]
    covered = glob_match(F.regexp_replace(F.coalesce("uri", F.lit("")), "^/+", ""), globs) | ((F.coalesce("name", F.lit("")) != "") & F.coalesce(glob_match(F.col("name"), list(trusted_names)), F.lit(False)))
    writes = routes.where(F.upper("method").isin("POST", "PUT", "PATCH", "DELETE") & ~covered)
    return writes.join(exposed.where("exposure = 'public'").select("route"), "route", "left_semi").select("route", F.when(F.upper("method") == "DELETE", "high").otherwise("medium").alias("severity"))


def fk_index(table_schemas: DataFrame) -> DataFrame:
    """(table, foreign_key): keys that no index covers with its leading columns in order; a key without columns is not covered."""
    each = table_schemas.select("table", "indexes", F.explode("foreign_keys").alias("fk"))
    covered = (F.size("fk.columns") > 0) & F.exists("indexes", lambda i: F.slice(i["columns"], 1, F.size("fk.columns")) == F.col("fk.columns"))
    return each.where(~F.coalesce(covered, F.lit(False))).select("table", F.col("fk.name").alias("foreign_key"))


def missing_alias(models: DataFrame, morph_map: DataFrame, enforced: bool = True) -> DataFrame:
    """Concrete models without an alias, where the map is enforced."""
    if not enforced:
        return models.limit(0)
    return models.where(~F.coalesce("abstract", F.lit(False))).join(morph_map.select("fqcn"), "fqcn", "left_anti")


def fk_orphans(relations: Sequence[tuple[str, DataFrame, str, DataFrame, str]]) -> DataFrame:
    """(relation, orphans) for each (name, child, child key, parent, parent key); null keys are no orphans."""
    parts = []
    for name, child, ckey, parent, pkey in relations:
        lost = child.select(F.col(ckey).alias("k")).where("k is not null").join(parent.select(F.col(pkey).alias("k")).distinct(), "k", "left_anti")
        parts.append(lost.agg(F.count("*").alias("orphans")).select(F.lit(name).alias("relation"), "orphans"))
    return reduce(DataFrame.union, parts)


def unresolved(call_edges: DataFrame) -> DataFrame:
    """(caller, callee): distinct calls whose target could not be resolved."""
    return call_edges.where("not resolved").select("caller", "callee").distinct()
