"""Quality rules as a short-circuit cascade.

Each rule's cost and rejection rate are measured on a bounded sample of the
whole table; the rules then run as nested CASEs in falling order of rejections per cost,
so that most rejected documents meet a cheap rule first and later rules are not
evaluated for them. The order changes the time, never the verdict.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, words

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_repeat_words")


@dataclass(frozen=True)
class Rule:
    """A document is rejected where ``rejects`` is true; it may use text, n_words and n_lines."""

    name: str
    rejects: Column


def default_rules() -> list[Rule]:
    text = F.coalesce("text", F.lit(""))
    left = lambda pattern: F.length(F.regexp_replace(text, pattern, ""))
    chars = left(r"[\x20\x09-\x0D]+")
    return [
        Rule("symbols", 10 * left(r"[^#*$%&|<>]+") > F.col("n_words")),
        Rule("capitals", 2 * left(r"[^A-Z]+") > left(r"[^A-Za-z]+")),
        Rule("digits", 2 * left(r"[^0-9]+") > chars),
        Rule("word_length", (chars < 2 * F.col("n_words")) | (chars > 15 * F.col("n_words"))),
        Rule("repeated_lines", 2 * F.col("n_dup_lines") > F.col("n_lines")),
    ]


def measures(docs: DataFrame) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_lines, n_repeat_words (long).

    Repeated three-word windows are found by sorting their 64-bit hashes with
    the position packed into the low bits; texts without a repeated hash skip
    the sort.
    """
    text = F.coalesce("text", F.lit(""))
    out = docs.withColumn("_w", words(F.col("text")))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    out = out.withColumns({"n_words": F.size("_w").cast("long"), "_lines": lines})
    windows = F.when(F.col("n_words") > 2, F.transform(F.sequence(F.lit(0), F.size("_w") - 3), lambda i: F.xxhash64(F.get("_w", i), F.get("_w", i + 1), F.get("_w", i + 2))))
    out = out.withColumns(
        {
            "word_chars": F.length(F.array_join("_w", "")).cast("long"),
            "n_symbols": F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long"),
            "n_lines": F.size("_lines").cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "_tri": windows,
            "_bits": F.length(F.bin("n_words")).cast("int"),
        }
    ).drop("_w", "_lines")
    mask = "shiftleft(1L, _bits) - 1"
    packed = F.expr("sort_array(transform(_tri, (h, i) -> shiftleft(shiftright(h, _bits), _bits) | cast(i as bigint)))")
    out = out.withColumn("_packed", F.when(F.size(F.array_distinct("_tri")) < F.size("_tri"), packed))
    out = out.withColumn("_ordered", F.expr(f"transform(_packed, p -> get(_tri, cast(p & ({mask}) as int)))"))
    hit = "filter(_packed, (p, j) -> get(_ordered, j) <=> get(_ordered, j - 1) or get(_ordered, j) <=> get(_ordered, j + 1) or get(_ordered, j) <=> get(_ordered, j - 2) or get(_ordered, j) <=> get(_ordered, j + 2))"
    out = out.withColumn("_at", F.expr(f"transform({hit}, p -> p & ({mask}))"))
    covered = F.size(F.array_distinct(F.concat("_at", F.transform("_at", lambda x: x + 1), F.transform("_at", lambda x: x + 2))))
    repeat = F.when(F.col("_at").isNull(), F.lit(0)).otherwise(covered).cast("long")
    out = out.withColumn("n_repeat_words", repeat)
    # The generator keeps a later filter on these columns above them: pushed down, it would repeat the array work.
    made = F.explode(F.array(F.struct(*MEASURES))).alias("_m")
    return out.select(*[F.col(f"`{c}`") for c in docs.columns if c not in MEASURES], made).select(*[F.col(f"`{c}`") for c in docs.columns if c not in MEASURES], "_m.*")


def base_failed(min_words: int = 50, repeat_percent: int = 50) -> Column:
    return (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > repeat_percent * F.col("n_words"))


def sample(docs: DataFrame, rows: int) -> DataFrame:
    """About ``rows`` of docs, each row being chosen by itself, so from every part of the table."""
    return docs.sample(min(1.0, rows / max(1, docs.count())), 7)


def rank_rules(measured: DataFrame, rules: list[Rule], repeat: int = 2) -> list[tuple[Rule, float, float]]:
    """(rule, seconds, share rejected) in the order to run, from measured rows whose number is bounded.

    Only rows that pass the base rules count, as only they meet the cascade. A
    rule's cost is the time that judging each row ``repeat`` times takes beyond
    a job that judges nothing, the lesser of two runs each.
    """
    rows = cut(measured.where(~base_failed()))
    many = rows.withColumn("again", F.explode(F.sequence(F.lit(1), F.lit(repeat))))

    def timed(verdict: Column) -> tuple[float, float]:
        took = []
        for _ in range(2):
            began = time.perf_counter()
            share = many.agg(F.avg(F.when(F.coalesce(verdict, F.lit(False)), 1.0).otherwise(0.0))).first()[0] or 0.0
            took.append(time.perf_counter() - began)
        return min(took), share

    base, _ = timed(F.col("n_words") < 0)
    found = []
    for rule in rules:
        seconds, share = timed(rule.rejects)
        found.append((rule, max(seconds - base, 1e-4), share))
    return sorted(found, key=lambda x: (-x[2] / x[1], x[1], x[0].name))


def cascade(rules: list[Rule]) -> Column:
    """Whether some rule rejects the row; in this order, those after the first that does are not evaluated."""
    out = F.lit(False)
    for rule in reversed(rules):
        out = F.when(F.coalesce(rule.rejects, F.lit(False)), True).otherwise(out)
    return out


def quality(docs: DataFrame, rules: list[Rule] | None = None, sample_rows: int = 1000) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept.

    A null text counts as empty: no words, base_failed, not kept. Columns of
    docs with these names are replaced; all other columns and every row,
    repeated ones included, are passed on. ``sample_rows`` bounds the rows on
    which costs and selectivities are estimated, which change the order of the
    rules and no result.
    """
    rules = default_rules() if rules is None else rules
    out = measures(docs).withColumn("base_failed", base_failed())
    order = [r for r, _, _ in rank_rules(measures(sample(docs, sample_rows)), rules)] if rules else []
    rejected = F.when(F.col("base_failed"), True).otherwise(cascade(order))
    return out.withColumn("kept", ~rejected).drop("n_lines")


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
x AS (SELECT doc_id, t, ws, len(ws) AS n_words, len(array_to_string(ws, '')) AS word_chars,
             len(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS n_symbols, len(ls) AS n_lines,
             len(ls) - len(list_distinct(ls)) AS n_dup_lines FROM w),
tri AS (SELECT doc_id, i, [ws[i], ws[i + 1], ws[i + 2]] AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM x)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM tri) WHERE c > 1),
cov AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM rep) GROUP BY doc_id),
b AS (SELECT x.*, coalesce(cov.n, 0) AS n_repeat_words,
             n_words < 50 OR 100 * coalesce(cov.n, 0) > 50 * n_words AS base_failed,
             len(regexp_replace(t, '[^A-Z]+', '', 'g')) AS upper_n, len(regexp_replace(t, '[^A-Za-z]+', '', 'g')) AS alpha_n,
             len(regexp_replace(t, '[^0-9]+', '', 'g')) AS digit_n
      FROM x LEFT JOIN cov USING (doc_id))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
       NOT base_failed AND NOT (10 * n_symbols > n_words) AND NOT (2 * upper_n > alpha_n) AND NOT (2 * digit_n > word_chars)
         AND NOT (word_chars < 2 * n_words OR word_chars > 15 * n_words) AND NOT (2 * n_dup_lines > n_lines) AS kept
FROM b
"""
