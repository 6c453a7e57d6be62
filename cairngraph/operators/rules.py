"""Large tables of rules matched through keys that both sides hold, never by pairing all of both."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import located

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
GRAM = 3


def _low(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def _tokens(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(c, F.lit("([a-z0-9_]+)"), F.lit(1)))


def _grams(c: Column, n: int) -> Column:
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - n + 1), lambda i: F.substr(c, i, F.lit(n))))


def _glob_regex(low: Column) -> Column:
    quoted = F.regexp_replace(low, r"([^A-Za-z0-9_/ *?-])", r"\\$1")
    return F.concat(F.lit("(?is)^"), F.replace(F.replace(quoted, F.lit("*"), F.lit(".*")), F.lit("?"), F.lit(".")), F.lit("$"))


#: Rule ids of one pattern that travel together, so many at most on average.
BLOCK = 1000


def _patterns(rules: DataFrame) -> DataFrame:
    """(rule_id, _p): the rules' patterns in lower case, each once."""
    return rules.where("pattern is not null").select("rule_id", _low(F.col("pattern")).alias("_p")).distinct()


def _glob_hits(values: DataFrame, patterns: DataFrame) -> DataFrame:
    """(value, _p): which distinct patterns(_p) match which distinct values(value), each pair once, as a pattern has one anchor."""
    seen = values.where("value is not null").select("value").distinct().withColumn("_low", _low(F.col("value")))
    words = F.array_distinct(F.regexp_extract_all("_p", F.lit(r"(?<![a-z0-9_*?])([a-z0-9_]+)(?![a-z0-9_*?])"), F.lit(1)))
    literals = F.array_sort(F.transform(F.regexp_extract_all("_p", F.lit("([^*?]+)"), F.lit(1)), lambda x: F.struct((-F.length(x)).alias("n"), x.alias("x"))))
    made = patterns.withColumn("_words", words).withColumn("_gram", F.substring(F.get(literals, 0)["x"], 1, GRAM)).withColumn("regex", _glob_regex(F.col("_p")))

    by_word = seen.select("value", F.explode(_tokens(F.col("_low"))).alias("_key"))
    held = by_word.groupBy("_key").agg(F.count("*").alias("_n"))
    each = made.select("_p", "regex", F.explode("_words").alias("_key"))
    complete = each.join(held, "_key", "left").groupBy("_p", "regex").agg(F.min_by("_key", F.coalesce("_n", F.lit(0))).alias("_key"))
    pairs = by_word.join(complete, "_key").select("value", "_p", "regex")
    rest = made.where(F.size("_words") == 0)
    for n in range(1, GRAM + 1):
        short = rest.where(F.length("_gram") == n).select("_p", "regex", F.col("_gram").alias("_key"))
        cut = seen.where(F.length("_low") >= n).select("value", F.explode(_grams(F.col("_low"), n)).alias("_key"))
        cut = cut.join(short.select("_key").distinct(), "_key", "left_semi")
        pairs = pairs.union(cut.join(short, "_key").select("value", "_p", "regex"))
    wild = rest.where("_gram is null").select("_p", "regex", F.length(F.replace("_p", F.lit("*"), F.lit(""))).alias("_least"), F.col("_p").contains("*").alias("_open"))
    lengths = seen.select(F.length("_low").alias("_length")).distinct()
    kinds = wild.select("_least", "_open").distinct()  # one for each length of pattern and openness, as lengths are
    allowed = kinds.join(lengths, (F.col("_length") == F.col("_least")) | (F.col("_open") & (F.col("_length") > F.col("_least"))))
    longs = wild.join(allowed, ["_least", "_open"]).select("_p", "regex", "_length")
    pairs = pairs.union(seen.select("value", F.length("_low").alias("_length")).join(longs, "_length").select("value", "_p", "regex"))
    return pairs.where(F.rlike("value", F.col("regex"))).select("value", "_p")


def match_globs(values: DataFrame, rules: DataFrame) -> DataFrame:
    """(value, rule_id): which of rules(rule_id, pattern) match which distinct values(value) whole, in any case of A-Z.

    In a pattern ``*`` is any run and ``?`` one character. Each pattern is found
    by one anchor that every match holds: of the words that stand between
    separators in it the one that the fewest values hold; without a word the
    first three characters of its longest literal, or all of a shorter one; a
    pattern of wildcards alone is found by the lengths it allows. Values are
    joined to patterns by their anchors, and the pairs tested. Null values and
    null patterns match nothing.

    Rules of one pattern share its matches: these meet blocks of rule ids, so
    what is tested, moved and held does not grow with the rules, and only the
    rows given do. Rules of several patterns are made distinct, no others.
    """
    made = _patterns(rules)
    hits = _glob_hits(values, made.select("_p").distinct()).repartition("value", "_p")
    own = made.groupBy("rule_id").agg(F.count("*").alias("_n"), F.min("_p").alias("_p"))
    one = own.where("_n = 1").select("rule_id", "_p")
    sizes = one.groupBy("_p").agg(F.ceil(F.count("*") / BLOCK).alias("_blocks"))
    blocks = one.join(sizes, "_p").groupBy("_p", F.pmod(F.xxhash64("rule_id"), F.col("_blocks")).alias("_block")).agg(F.collect_list(F.struct("rule_id")).alias("_ids"))  # structs, as lists leave nulls out
    dealt = hits.join(sizes, "_p").select("value", "_p", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1)).alias("_block"))
    single = dealt.join(blocks, ["_p", "_block"]).select("value", F.explode("_ids").alias("_id")).select("value", "_id.rule_id")
    several = made.join(own.where("_n > 1").select("rule_id"), "rule_id", "left_semi")
    return single.union(hits.join(several, "_p").select("value", "rule_id").distinct())


def first_rule(values: DataFrame, rules: DataFrame, default: str) -> DataFrame:
    """(value, label): for each distinct value the label of the least rule_id of rules(rule_id, pattern, label) that matches, else default."""
    first = _patterns(rules).groupBy("_p").agg(F.min("rule_id").alias("rule_id"))
    least = _glob_hits(values, first.select("_p")).join(first, "_p").groupBy("value").agg(F.min("rule_id").alias("rule_id"))
    found = least.join(rules.groupBy("rule_id").agg(F.min("label").alias("label")), "rule_id").select("value", "label")
    return values.select("value").distinct().join(found, "value", "left").select("value", F.coalesce("label", F.lit(default)).alias("label"))


def match_guards(guards: DataFrame, rules: DataFrame, sep: str = "\\") -> DataFrame:
    """(name, rule_id): which of rules(rule_id, pattern) match which distinct guards(name), as guard_match matches one by one.

    Both sides name what they can be equal in: the whole guard, what stands
    before one of its ``:`` or of its separators, and the base name of a class.
    """
    entry = lambda kind, key: F.struct(F.lit(kind).alias("kind"), key.alias("key"))

    def before(low: Column, at: str, kind: str) -> Column:
        parts = F.split(low, f"[{at * 2 if at == chr(92) else at}]", -1)
        cuts = F.slice(F.sequence(F.lit(1), F.size(parts)), 1, F.size(parts) - 1)
        return F.transform(cuts, lambda n: F.struct(F.lit(kind).alias("kind"), F.array_join(F.slice(parts, 1, n), at).alias("key")))

    low = F.lower("name")
    base = lambda c: F.substring_index(F.substring_index(c, ":", 1), sep, -1)
    keys = F.concat(F.array(entry("whole", low)), before(low, ":", "colon"), before(low, sep, "sep"), F.filter(F.array(entry("base", base(low))), lambda k: k["key"] != ""))
    held = guards.where("name is not null").select("name").distinct().select("name", F.explode(F.array_distinct(keys)).alias("k")).select("name", "k.*")

    p = F.lower("pattern")
    opened = F.array(entry("whole", F.regexp_replace(p, ":+$", "")), entry("colon", F.regexp_replace(p, ":$", "")))
    plain = F.array(entry("whole", p), entry("colon", p), entry("sep", p))
    plain = F.when(p.contains(sep), F.concat(plain, F.array(entry("base", base(p))))).otherwise(plain)
    wanted = rules.where("pattern is not null").select("rule_id", F.explode(F.when(p.endswith(":"), opened).otherwise(plain)).alias("k")).select("rule_id", "k.*")
    return held.join(wanted, ["kind", "key"]).select("name", "rule_id").distinct()


#: Texts that a task tests.
TEXTS = 1000


def scan_table(sources: DataFrame, rules: DataFrame) -> DataFrame:
    """(file, line, rule, severity, snippet): matches of rules(rule, anchor, regex, severity) in the whole text of sources(file, text).

    ``anchor`` is a word of A-Z, a-z, 0-9 and _ that each match holds as a whole
    word, in any case, or in its own where rules has a column ``cased`` that is
    true; a text is tested against the rules whose anchors it holds. Words meet
    the anchors under a hash of their text; two texts of one hash would only be
    tested against more rules. Rules of one anchor and regex are tested once. A
    text moves once, with the list of what it is tested for, to one of as many
    tasks as the number of texts asks for: by their size Spark would put them
    in few, though testing them is the work.
    """
    held = sources.where("text is not null").select("file", "text", F.xxhash64("file", "text").alias("_at"))
    cased = F.coalesce("cased", F.lit(False)) if "cased" in rules.columns else F.lit(False)
    anchor = F.when(cased, F.col("anchor")).otherwise(_low(F.col("anchor")))
    wanted = rules.where("anchor is not null and regex is not null").select(F.struct(anchor.alias("anchor"), cased.alias("cased"), "regex").alias("_test"), "rule", "severity")
    tests = wanted.select("_test", _low(F.col("_test.anchor")).alias("_key")).distinct()
    words = held.select("_at", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"(\w+)"), F.lit(1)))).alias("_word"))
    met = words.withColumn("_key", _low(F.col("_word"))).join(tests, "_key").where(~F.col("_test.cased") | (F.col("_word") == F.col("_test.anchor")))
    tasks = max(1, sources.count() // TEXTS)
    lists = met.select("_at", "_test").distinct().repartition(tasks, "_at").groupBy("_at").agg(F.collect_list("_test").alias("_tests"))
    each = held.repartition(tasks, "_at").join(lists, "_at").select("file", "text", F.posexplode("_tests").alias("_n", "rule"))
    found = located(each.select("file", "text", "rule", F.col("rule.regex").alias("regex"), F.lit(None).alias("severity")))
    return found.withColumnRenamed("rule", "_test").drop("severity").join(wanted, "_test").select("file", "line", "rule", "severity", "snippet")
