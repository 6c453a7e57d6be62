"""Text jobs: rule scans, reference extraction, prefilters and name mentions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.exprs import contains_any, glob_match, truncate


def rule_scan(sources: DataFrame, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """(file, line, rule, severity, snippet): one row per match of rules(id, regex, severity) in a line of sources(file, text).

    Lines count from 1. Texts that no rule matches are dropped before they are
    split.
    """
    any_rule = "|".join(f"(?:{r[1]})" for r in rules)
    lines = sources.where(F.col("text").rlike(any_rule)).select("file", F.posexplode(F.split("text", "\n")).alias("_at", "_line")).where(F.col("_line").rlike(any_rule))
    found = [F.struct(F.lit(i).alias("rule"), F.lit(s).alias("severity"), F.regexp_extract_all("_line", F.lit(p), F.lit(0)).alias("hits")) for i, p, s in rules]
    each = lines.select("file", (F.col("_at") + 1).alias("line"), F.explode(F.array(*found)).alias("r"))
    return each.select("file", "line", "r.rule", "r.severity", F.explode("r.hits").alias("hit")).withColumn("snippet", truncate(F.col("hit"), 60, 57, "...")).drop("hit")


def spanning_scan(sources: DataFrame, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """(file, line, rule, severity, snippet): one row per match of rules(id, regex, severity) in the whole text of sources(file, text).

    A match may span lines and counts for the line in which it starts; no rule
    may match an empty text. See ``located``.
    """
    matching = [F.when(F.col("text").rlike(p), F.struct(F.lit(i).alias("rule"), F.lit(p).alias("regex"), F.lit(s).alias("severity"))) for i, p, s in rules]
    return located(sources.select("file", "text", F.explode(F.array_compact(F.array(*matching))).alias("_r")).select("file", "text", "_r.*"))


#: Stands around matches, with a hash of the text behind it in texts that hold it themselves.
MARK = "\u0001"


def located(found: DataFrame) -> DataFrame:
    """(file, line, rule, severity, snippet): the matches in found(file, text, rule, regex, severity), with the lines in which they start.

    Each regex goes through its text once and marks its matches there; the text
    is cut at the marks, so that every second piece is a match, and the newlines
    of the pieces before it are summed over rows.
    """
    mark = F.when(F.col("text").contains(MARK), F.concat(F.lit(MARK), F.sha2("text", 256))).otherwise(F.lit(MARK))
    pieces = F.split(F.regexp_replace("text", F.col("regex"), F.concat(mark, F.lit("$0"), mark)), mark, -1)
    rows = found.select("file", "text", "regex", "rule", "severity", F.monotonically_increasing_id().alias("_text"))
    rows = rows.select("file", "rule", "severity", "_text", F.posexplode(pieces).alias("_at", "_piece"))
    newlines = F.length("_piece") - F.length(F.replace("_piece", F.lit("\n"), F.lit("")))
    own = F.col("_at") % 2 == 1
    rows = rows.select("file", "rule", "severity", "_text", "_at", newlines.alias("_lines"), F.when(own, truncate(F.col("_piece"), 60, 57, "...")).alias("snippet"))
    before = W.partitionBy("_text").orderBy("_at").rowsBetween(W.unboundedPreceding, -1)
    return rows.withColumn("line", (F.sum("_lines").over(before) + 1).cast("int")).where(own).select("file", "line", "rule", "severity", "snippet")


# Words that tell of raw user content.
RISKY_WORDS = "html body content description text message comment note remark bio about summary input data raw unsafe user post output".split()


def finding_severity(findings: DataFrame, tainted: DataFrame, risky: Sequence[str] = RISKY_WORDS) -> DataFrame:
    """findings(file, message, ...) with severity: high if the message, in any case, holds a name of tainted(file, name) or a risky word, else medium."""
    names = tainted.groupBy("file").agg(F.collect_set(F.lower("name")).alias("_names"))
    low = F.lower("message")
    hit = F.coalesce(F.exists("_names", lambda n: low.contains(n)), F.lit(False))
    return findings.join(names, "file", "left").withColumn("severity", F.when(hit | F.coalesce(contains_any(F.col("message"), list(risky)), F.lit(False)), "high").otherwise("medium")).drop("_names")


def page_refs(pages: DataFrame) -> DataFrame:
    """(page_id, href): the distinct addresses within the site that pages(page_id, html) refer to."""
    return pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="(/[^"]*)"'), F.lit(1))).alias("href")).distinct()


# Component tags that are no templates.
NO_TEMPLATES = ("slot", "dynamic-component")


def template_refs(sources: DataFrame, names: DataFrame) -> DataFrame:
    """(parent, child): templates that sources(name, text) include, if they exist in names(name).

    Includes, conditional includes, first-of lists and component tags are read;
    names with ``::`` or ``$`` are left out. A component stands for
    ``components.x`` and, if that does not exist, ``components.x.index``; tags
    with ``::`` and those that name no template are left out.
    """
    quoted = r"['\"]([^'\"]+)['\"]"
    every = lambda pattern: F.regexp_extract_all("text", F.lit(pattern), F.lit(1))
    direct, cond = every(rf"@(?:include|extends|each|component|includeIf)\s*\(\s*{quoted}"), every(rf"@include(?:When|Unless)\s*\(\s*[^,]+,\s*{quoted}")
    lists = F.flatten(F.transform(every(r"@includeFirst\s*\(\s*\[([^\]]*)\]"), lambda x: F.regexp_extract_all(x, F.lit(quoted), F.lit(1))))
    named = sources.select(F.col("name").alias("parent"), F.explode(F.concat(direct, cond, lists)).alias("child"), F.lit(0).alias("level"))
    tags = sources.select(F.col("name").alias("parent"), F.explode(every(r"<\s*x-([A-Za-z0-9._:-]+)")).alias("tag")).where(~F.col("tag").isin(*NO_TEMPLATES) & ~F.col("tag").contains("::"))
    plain = tags.select("parent", F.concat(F.lit("components."), "tag").alias("child"), F.lit(1).alias("level"), F.col("tag"))
    index = tags.select("parent", F.concat(F.lit("components."), "tag", F.lit(".index")), F.lit(2), "tag")
    comp = plain.union(index).join(names.select(F.col("name").alias("child")).distinct(), "child", "left_semi")
    best = comp.groupBy("parent", "tag").agg(F.min_by("child", "level").alias("child")).select("parent", "child")
    kept = named.where(~F.col("child").contains("::") & ~F.col("child").contains("$")).join(names.select(F.col("name").alias("child")).distinct(), "child", "left_semi").select("parent", "child")
    return kept.union(best).distinct()


def prefilter(sources: DataFrame, literals: Sequence[str]) -> DataFrame:
    """Sources that hold any of the literals, by plain containment."""
    hit = F.lit(False)
    for x in literals:
        hit = hit | F.col("text").contains(x)
    return sources.where(hit)


def name_mentions(sources: DataFrame, names: DataFrame, token: str = r"([A-Za-z0-9_]{3,})") -> DataFrame:
    """(name, file): which sources(file, text) mention which names(name, file) of another file, by equal tokens."""
    tokens = sources.select("file", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(token), F.lit(1)))).alias("name"))
    own = names.select("name", F.col("file").alias("_own"))
    return tokens.join(own, "name").where(F.col("_own").isNull() | (F.col("_own") != F.col("file"))).select("name", "file").distinct()


def under_roots(paths: DataFrame, roots: Sequence[str], globs: Sequence[str] = ()) -> DataFrame:
    """paths(path) with ``inside``: under a root, or matching a glob."""
    inside = F.lit(False)
    for r in roots:
        inside = inside | F.col("path").startswith(r.rstrip("/") + "/") | (F.col("path") == r.rstrip("/"))
    return paths.withColumn("inside", inside | glob_match(F.col("path"), list(globs)))
