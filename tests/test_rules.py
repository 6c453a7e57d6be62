"""Rule tables against pairing every rule with every value."""

import random
import re

import pytest
from pyspark.sql import functions as F

from cairngraph.functions.exprs import glob_regex, guard_match
from cairngraph.operators import rules, text

WORDS = ["app", "Http", "Models", "User", "post", "a", "b1", "x_y", "Ünï", "ıx"]


def path(rng):
    return rng.choice(["/", "", "."]).join(rng.choice(WORDS) for _ in range(rng.randint(1, 4))) + rng.choice(["", ".php", "Controller.php", "\nx", "[1]"])


def glob(rng):
    kind = rng.randint(0, 5)
    if kind == 0:
        return rng.choice(["*", "?", "??", "*?*", "?" * rng.randint(1, 9), "", "?" * rng.randint(3, 9) + "*"])
    p = list(path(rng))
    for _ in range(rng.randint(0, 3)):
        if p:
            p[rng.randrange(len(p))] = rng.choice("*?")
    return "".join(p).upper() if kind == 1 else "".join(p)


def test_globs_equal_testing_every_pair(spark):
    rng = random.Random(3)
    values = {path(rng) for _ in range(150)} | {"", "a", "AB", "a.b", "é"}
    made = [(n, glob(rng)) for n in range(400)] + [(900, None), (5, "app*"), (5, "*")]
    got = rules.match_globs(spark.createDataFrame([(v,) for v in [*values, *list(values)[:9], None]], "value string"), spark.createDataFrame(made, "rule_id long, pattern string"))
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    want = {(v, n) for v in values for n, p in made if p is not None and re.fullmatch("".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in p.translate(fold)), v.translate(fold), re.S)}
    assert {tuple(r) for r in got.collect()} == want
    assert got.count() == len(want)


def test_many_globs_need_no_pairing(spark):
    n = 100_000
    made = spark.range(n).select(F.col("id").alias("rule_id"), F.concat(F.lit("*/pkg"), F.col("id").cast("string"), F.lit("/*.php")).alias("pattern"))
    values = spark.range(5_000).select(F.concat(F.lit("src/pkg"), (F.col("id") * 7).cast("string"), F.lit("/x.php")).alias("value"))
    got = rules.match_globs(values, made)
    assert got.count() == 5_000
    assert "CartesianProduct" not in got._jdf.queryExecution().toString()


def test_first_rule_by_order_else_default(spark):
    made = spark.createDataFrame([(2, "app/*", "late"), (1, "*user*", "user")], "rule_id long, pattern string, label string")
    values = spark.createDataFrame([("app/User",), ("app/x",), ("lib/x",), (None,)], "value string")
    assert {tuple(r) for r in rules.first_rule(values, made, "none").collect()} == {("app/User", "user"), ("app/x", "late"), ("lib/x", "none"), (None, "none")}


def test_guards_equal_the_expression(spark):
    names = ["auth", "auth:api", "AUTH:api:x", "can:edit", "App\\Auth", "App\\Auth:api", "Lib\\Auth\\Deep", "authx", "", ":", "\\", "a:b\\c", "web\\x:y"]
    patterns = ["auth", "auth:", "auth::", "can:edit", "Other\\Auth", "app", "App\\", "", ":", "lib\\auth", "a:b", "deep", "X\\deep:y"]
    got = rules.match_guards(spark.createDataFrame([(n,) for n in [*names, None, "auth"]], "name string"), spark.createDataFrame(list(enumerate([*patterns, None])), "rule_id long, pattern string"))
    df = spark.createDataFrame([(n,) for n in names], "name string")
    want = {(r.name, i) for i, p in enumerate(patterns) for r in df.where(guard_match(F.col("name"), [p])).collect()}
    assert {tuple(r) for r in got.collect()} == want


@pytest.mark.parametrize("scan", ["list", "table"])
def test_matches_over_lines_count_for_their_first(spark, scan):
    source = "a\neval(\n $x)\n eval($y) eval(\n\n$z)\neval(" + "w" * 80 + ")"
    docs = spark.createDataFrame([("f", source), ("g", "none\n"), ("h", None), ("h", ""), ("f", "eval(1)")], "file string, text string")
    rule = ("eval", r"eval\([^)]*\)", "high")
    got = text.spanning_scan(docs, [rule, ("nothing", "qqq", "low")]) if scan == "list" else rules.scan_table(docs, spark.createDataFrame([("eval", "EVAL", rule[1], "high"), ("other", "none", rule[1], "low")], "rule string, anchor string, regex string, severity string"))
    want = [("f", 1, "eval(1)"), ("f", 2, "eval(\n $x)"), ("f", 4, "eval($y)"), ("f", 4, "eval(\n\n$z)"), ("f", 7, "eval(" + "w" * 52 + "...")]
    assert sorted((r.file, r.line, r.snippet) for r in got.collect()) == sorted(want)


def test_words_of_long_texts_do_not_carry_them(spark):
    many = " ".join(f"w{n}" for n in range(60_000))
    docs = spark.createDataFrame([(n, many + " Key x\nkey y\nKEY z") for n in range(3)], "file long, text string")
    made = [("any", "key", "(?i)key [a-z]", "low", None), ("own", "Key", "Key [a-z]", "low", True), ("none", "keY", "(?i)key", "low", True)]
    got = rules.scan_table(docs, spark.createDataFrame(made, "rule string, anchor string, regex string, severity string, cased boolean"))
    each = [("any", 1, "Key x"), ("any", 2, "key y"), ("any", 3, "KEY z"), ("own", 1, "Key x")]
    assert sorted((r.file, r.rule, r.line, r.snippet) for r in got.collect()) == sorted((n, *e) for n in range(3) for e in each)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    words = [line for line in plan.splitlines() if "Generate explode" in line]
    assert len(words) == 1 and "_word" in words[0] and "text" not in words[0].split("[_word")[0].split("),")[-1]


def test_glob_regex_is_literal_but_for_wildcards():
    assert re.fullmatch(glob_regex("a.b[*]?"), "a.b[xyz]!")


def test_rules_of_one_pattern_share_its_matches(spark):
    n = 3 * rules.BLOCK + 7
    values = spark.createDataFrame([("a/x",), ("a/y",), ("b/y",), (None,)], "value string")
    many = spark.range(n).select("id", F.lit("A/*").alias("pattern"))
    made = many.union(spark.createDataFrame([(-1, "a/*"), (-1, "*/y"), (-2, "?/x"), (-3, None), (None, "b/*")], "id long, pattern string")).toDF("rule_id", "pattern")
    got = rules.match_globs(values, made)
    assert got.count() == got.distinct().count() == 2 * n + 3 + 1 + 1
    assert sorted(tuple(r) for r in got.where("rule_id < 0").collect()) == [("a/x", -2), ("a/x", -1), ("a/y", -1), ("b/y", -1)]
    assert got.where("value like 'a%' and rule_id >= 0").groupBy("value").count().where(F.col("count") == n).count() == 2
    assert got.where("rule_id is null").first().value == "b/y"
    assert rules._glob_hits(values, rules._patterns(made).select("_p").distinct()).count() == 2 + 2 + 1 + 1  # pairs of patterns, however many rules


def test_rules_of_one_test_go_through_a_text_once(spark, monkeypatch):
    tested = []
    monkeypatch.setattr(rules, "located", lambda found: tested.append(found) or text.located(found))
    source = "key a\x01b\nkey \x01key c\n\x01\nno\nkey d"
    docs = spark.createDataFrame([(1, source), (2, "key z"), (3, "none")], "file long, text string")
    made = [(f"r{n}", "key" if n % 2 else "KEY", r"(?:^|\W)key [a-z]", f"s{n}") for n in range(50)]
    got = rules.scan_table(docs, spark.createDataFrame(made, "rule string, anchor string, regex string, severity string"))
    each = [(1, 1, "key a"), (1, 2, "\x01key c"), (1, 5, "\nkey d"), (2, 1, "key z")]
    want = [(f, line - 1 if s[0] == "\n" else line, f"r{n}", f"s{n}", s) for f, line, s in each for n in range(50)]
    assert sorted((r.file, r.line, r.rule, r.severity, r.snippet) for r in got.collect()) == sorted(want)
    assert tested[0].count() == 2
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(") == 1 and "RLIKE" not in plan and plan.count("regexp_extract_all(") == 1  # the words
