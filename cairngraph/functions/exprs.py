"""Scalar column functions: ids, names, classification, matching and formatting."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEVERITIES = ("none", "low", "medium", "high", "critical")

# Kinds of cache operations by method name.
CACHE_OPERATIONS = {
    "get": "read",
    "many": "read",
    "getMultiple": "read",
    "has": "read",
    "missing": "read",
    "remember": "read",
    "rememberForever": "read",
    "sear": "read",
    "flexible": "read",
    "put": "write",
    "set": "write",
    "putMany": "write",
    "setMultiple": "write",
    "add": "write",
    "forever": "write",
    "increment": "write",
    "decrement": "write",
    "forget": "invalidate",
    "delete": "invalidate",
    "deleteMultiple": "invalidate",
    "pull": "invalidate",
    "flush": "invalidate",
    "clear": "invalidate",
    "lock": "lock",
    "restoreLock": "lock",
}

# Names of the sidebar's buckets by tab category.
TAB_BUCKETS = {
    "Command": "Console Commands",
    "Channel": "Broadcast Channels",
    "Schedule": "Schedules",
    "ERD": "Model ERD",
    "Events": "Event Choreography",
    "AI": "AI Agents",
    "Reachability": "Reachability",
}
PANEL_CATEGORY = "Filament"


def is_controller(name: Column) -> Column:
    """Whether a class counts as a controller by its name or namespace."""
    return name.contains("Controller") | name.contains("\\Http\\") | name.contains("\\Livewire\\")


def node_id(name: Column, method: Column) -> Column:
    """Canonical id of a hop.

    Ids of closure routes and schedules are the name itself, templates are
    ``view::`` and their lower-cased name, controllers ``action::name::method``;
    any other name has each character but letters, digits and ``_`` made ``_``
    and is followed by ``::method``.
    """
    view = F.concat(F.lit("view::"), F.lower(F.regexp_replace(name, "[^a-zA-Z0-9._]", "_")))
    plain = F.concat(F.lower(F.regexp_replace(name, "[^a-zA-Z0-9_]", "_")), F.lit("::"), method)
    virtual = name.startswith("route::") | name.startswith("schedule::")
    return F.when(name.startswith("blade::"), view).when(virtual, name).when(is_controller(name), F.concat_ws("::", F.lit("action"), name, method)).otherwise(plain)


def short_name(col: Column, sep: str = "\\") -> Column:
    """Text after the last separator."""
    return F.substring_index(col, sep, -1)


def classify(col: Column, rules: list[tuple[str, str]], default: str) -> Column:
    """Label of the first rule (regex, label) that matches, else default."""
    out = reduce(lambda acc, r: acc.when(col.rlike(r[0]), F.lit(r[1])), rules, F)
    return out.otherwise(F.lit(default)) if rules else F.lit(default)


def lookup(col: Column, table: dict[str, str], default: str | None = None) -> Column:
    """Value of a small literal map, else default."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), col), F.lit(default))


def glob_regex(pattern: str) -> str:
    """Regex of a glob: ``*`` any run, ``?`` one character, anything else literal."""
    return "".join(".*" if c == "*" else "." if c == "?" else re.sub(r"([^A-Za-z0-9_/ -])", r"\\\1", c) for c in pattern)


def glob_match(col: Column, patterns: list[str]) -> Column:
    """Case-insensitive match of the whole value against any glob."""
    return col.rlike("(?is)^(?:" + "|".join(map(glob_regex, patterns)) + ")$") if patterns else F.lit(False)


def guard_match(col: Column, patterns: list[str], sep: str = "\\") -> Column:
    """Whether a guard, in any case, matches one of the patterns.

    A pattern ending in ``:`` matches as a prefix or without its colon. Any
    other matches the whole guard or as what stands before ``:`` or sep, and a
    pattern that holds sep also every class of the same base name.
    """
    low = F.lower(col)
    base = F.substring_index(F.substring_index(low, ":", 1), sep, -1)

    def one(pattern: str) -> Column:
        p = pattern.lower()
        if p.endswith(":"):
            return low.startswith(p) | (low == p.rstrip(":"))
        hit = (low == p) | low.startswith(f"{p}:") | low.startswith(p + sep)
        return hit | ((base != "") & (base == p.split(":")[0].rsplit(sep, 1)[-1])) if sep in p else hit

    return reduce(lambda a, b: a | b, map(one, patterns), F.lit(False))


def contains_any(col: Column, words: list[str]) -> Column:
    """Whether the lower-cased value holds any of the words."""
    return F.lower(col).rlike("|".join(re.escape(w.lower()) for w in words)) if words else F.lit(False)


def tier(cc: Column) -> Column:
    """Complexity tier: 1-5 low, 6-10 moderate, 11-15 high, 16 and more severe."""
    return F.when(cc <= 5, "low").when(cc <= 10, "moderate").when(cc <= 15, "high").otherwise("severe")


def cadence(frequency: Column, args: Column) -> Column:
    """The raw expression for ``cron``, else ``name args``; empty without a frequency."""
    joined = F.array_join(args, ", ")
    return F.when(frequency.isNull() | (frequency == ""), "").when((frequency == "cron") & (F.size(args) > 0), F.get(args, 0)).otherwise(F.trim(F.concat_ws(" ", frequency, joined)))


def slug(col: Column, max_len: int = 100) -> Column:
    """Lower case, non-alphanumeric runs as ``-``, trimmed; beyond max_len cut there and given 8 characters of the text's own hash."""
    s = F.lower(F.regexp_replace(F.regexp_replace(col, "[^a-zA-Z0-9]+", "-"), "^-+|-+$", ""))
    return F.when(F.length(s) > max_len, F.concat(F.substring(s, 1, max_len), F.lit("-"), F.substring(F.md5(col), 1, 8))).otherwise(s)


def rel_path(col: Column, folder: str, default: str) -> Column:
    """What follows the first ``/folder/``, with forward slashes; else the base name; default for an empty path."""
    path = F.regexp_replace(col, r"\\", "/")
    inner = F.nullif(F.regexp_extract(path, f"/{folder}/(.+)$", 1), F.lit(""))
    return F.when(F.coalesce(col, F.lit("")) == "", F.lit(default)).otherwise(F.coalesce(inner, F.substring_index(path, "/", -1)))


def table_name(name: Column) -> Column:
    """Conventional table of a class: its short name in snake case, each capital a new word, plural."""
    snake = F.lower(F.regexp_replace(F.substring_index(name, "\\", -1), "(?<!^)([A-Z])", "_$1"))
    plural = F.when(snake.rlike("[^aeiou]y$"), F.concat(F.regexp_replace(snake, "y$", ""), F.lit("ies")))
    return plural.when(snake.rlike("(ss|x|ch|sh)$"), F.concat(snake, F.lit("es"))).otherwise(F.concat(snake, F.lit("s")))


def statement_target(sql: Column) -> Column:
    """First word after FROM, INTO, UPDATE or TABLE; null if there is none."""
    return F.nullif(F.regexp_extract(sql, r"(?i)\b(?:FROM|INTO|UPDATE|TABLE)\s+`?(\w+)`?", 1), F.lit(""))


def truncate(col: Column, longest: int, keep: int, mark: str) -> Column:
    """Values longer than ``longest`` become their first ``keep`` characters and the mark."""
    return F.when(F.length(col) > longest, F.concat(F.substring(col, 1, keep), F.lit(mark))).otherwise(col)


#: Variant types that a field of each kind may have.
JSON_TYPES = {"bigint": ["BIGINT"], "int": ["BIGINT"], "double": ["BIGINT", "DOUBLE", "DECIMAL"], "string": ["STRING"], "boolean": ["BOOLEAN"]}


def payload(col: Column, path: str, kind: str, default=None) -> Column:
    """JSON field of the kind; default where it is absent or of another type (a text that looks like a number is a text)."""
    field = F.try_variant_get(F.try_parse_json(col), path, "variant")
    of_kind = F.regexp_extract(F.schema_of_variant(field), "^([A-Z]+)", 1).isin(*JSON_TYPES[kind])
    return F.coalesce(F.when(of_kind, F.try_variant_get(field, "$", kind)), F.lit(default).cast(kind))


def op_kind(method: Column) -> Column:
    """read, write, invalidate or lock of a cache method; null for any other."""
    return lookup(method, CACHE_OPERATIONS)


def call_attrs(calls: DataFrame) -> DataFrame:
    """calls(verb, url, key_source, ...) with host, asynchronous and address.

    ``key_source`` is config or env where the address is read from there. An
    address ending in ``…`` was put together at run time, an empty one is
    dynamic, any other literal.
    """
    url = F.coalesce("url", F.lit(""))
    address = F.when(F.col("key_source").isin("config", "env"), F.col("key_source")).when(url == "", "dynamic").when(url.endswith("…"), "constructed").otherwise("literal")
    host = F.coalesce(F.try_parse_url(F.rtrim(url, F.lit("…")), F.lit("HOST")), F.lit(""))
    return calls.withColumns({"host": host, "asynchronous": F.col("verb").endswith("Async"), "address": address})


def is_async(edge_type: Column) -> Column:
    """Whether an edge type fires and forgets: it leads to a job or to an event."""
    return edge_type.contains("-to-job") | edge_type.contains("-to-event")


def severity_rank(col: Column) -> Column:
    """Position in none < low < medium < high < critical; a missing value counts as low, an unknown one as none."""
    return F.greatest(F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), F.coalesce(F.lower(col), F.lit("low"))) - 1, F.lit(0)).cast("int")


def severity_name(rank: Column) -> Column:
    return F.get(F.array(*[F.lit(s) for s in SEVERITIES]), F.coalesce(rank, F.lit(0)).cast("int"))


def max_severity(col: Column) -> Column:
    """Aggregate: the highest severity; ``none`` for an empty group."""
    return severity_name(F.max(severity_rank(col)))


def tab_bucket(category: Column, panel: Column) -> Column:
    """Bucket of a tab by its category; tabs of panels by their panel's name with a capital first letter; else Other."""
    named = F.concat(F.lit(f"{PANEL_CATEGORY} · "), F.upper(F.substring(panel, 1, 1)), F.regexp_replace(panel, "(?s)^.", ""), F.lit(" Panel"))
    by_panel = F.when(F.length(panel) > 0, named).otherwise(F.lit(PANEL_CATEGORY))
    return F.when(category == PANEL_CATEGORY, by_panel).otherwise(lookup(category, TAB_BUCKETS, "Other"))
