"""Secret scan: fixed patterns plus a character Markov test for random strings.

Two character bigram models are trained from labelled samples: the values that
the fixed patterns find are random strings, the other words of a bounded
sample of documents are ordinary identifiers, but for the long ones that are
to be judged. A token of ``LEAST`` characters or more is reported if its
log-likelihood ratio is high, whatever characters it has. A bigram that comes
again in a token is no new evidence, so a run of one character is not random.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "random")
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"(AKIA[A-Z0-9]+)"
HEX = r"([0-9a-f]+)"
LEAST = 16
TOKEN = rf"([A-Za-z0-9+/_-]{{{LEAST},}}=*)"
ALPHABET = 128


@dataclass(frozen=True)
class MarkovPair:
    """Log-likelihood ratios, random to ordinary, of each ASCII bigram (row-major) and the limits of a report."""

    ratios: tuple[float, ...]
    per_char: float = 1.0
    total: float = 20.0
    #: From so many bigrams on, repeats are usual in random strings too and the limit grows no more.
    most: int = 64

    def score(self, token: str) -> float:
        return sum(self.ratios[ord(a) * ALPHABET + ord(b)] for a, b in set(zip(token, token[1:])))

    def column(self, token: Column) -> Column:
        """The same score as an expression, linear in the token's length."""
        table = F.split(F.lit(",".join(f"{x:.6g}" for x in self.ratios)), ",").cast("array<double>")
        codes = F.transform(F.split(token, ""), lambda c: F.ascii(c))
        pairs = F.zip_with(F.slice(codes, 1, F.length(token) - 1), F.slice(codes, 2, F.length(token) - 1), lambda a, b: a * ALPHABET + b)
        return F.aggregate(F.array_distinct(pairs), F.lit(0.0), lambda acc, x: acc + F.coalesce(F.get(table, x), F.lit(0.0)))


def _running(items: Column, none: Column, step: Callable[[Column, Column], tuple[Column, Column]]) -> Column:
    """The non-null second results of step(position, item), which first gives the next position, from 0 on.

    An array that grows by one is copied each time, so items are folded in
    blocks of about the square root of their number, whose results are joined.
    """
    width = lambda x: F.ceil(F.sqrt(F.size(x))).cast("int")
    cut_up = lambda x: F.transform(F.sequence(F.lit(0), F.size(x) - 1, width(x)), lambda i: F.slice(x, i + 1, width(x)))
    # as an array's only element, the items are computed once and not for every block
    blocks = F.flatten(F.transform(F.filter(F.array(items), lambda x: F.size(x) > 0), cut_up))

    def inner(acc: Column, item: Column) -> Column:
        pos, out = step(acc["pos"], item)
        return F.struct(pos.cast("int").alias("pos"), F.when(out.isNotNull(), F.array_append(acc["out"], out)).otherwise(acc["out"]).alias("out"))

    def outer(acc: Column, block: Column) -> Column:
        done = F.array(F.aggregate(block, F.struct(acc["pos"].alias("pos"), none.alias("out")), inner))
        return F.get(F.transform(done, lambda d: F.struct(d["pos"].alias("pos"), F.array_append(acc["out"], d["out"]).alias("out"))), F.lit(0))

    start = F.struct(F.lit(0).alias("pos"), F.slice(F.array(none), 1, 0).alias("out"))
    return F.aggregate(blocks, start, outer, lambda acc: F.flatten(acc["out"]))


def _spans(text: Column, pattern: str, value_group: int, least: int) -> Column:
    """array<struct<start, end, hit>>: leftmost non-overlapping matches whose value has ``least`` characters."""
    whole = f"(?:{pattern})"
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(value_group))
    gaps = F.transform(F.split(text, whole, -1), lambda x: F.length(x))
    steps = F.arrays_zip(gaps.alias("gap"), found.alias("hit"), F.transform(values, lambda v: F.length(v)).alias("long"))
    none = F.array().cast("array<struct<start:int,end:int,hit:string>>")

    def step(pos: Column, s: Column) -> tuple[Column, Column]:
        start = pos + s["gap"]
        stop = start + F.coalesce(F.length(s["hit"]), F.lit(0))
        return stop, F.when(s["long"] >= least, F.struct(start.alias("start"), stop.alias("end"), s["hit"].alias("hit")))

    return F.when(text.rlike(pattern), _running(steps, none, step)).otherwise(none)


def base_spans(docs: DataFrame) -> DataFrame:
    """docs with assign, access and hex: arrays of (start, end, hit), in code points."""
    text = F.coalesce("text", F.lit(""))
    none = F.array().cast("array<struct<start:int,end:int,hit:string>>")
    return docs.withColumns(
        {
            "assign": _spans(text, ASSIGN, 2, 8),
            "access": F.when(text.contains("AKIA"), _spans(text, ACCESS, 1, 16)).otherwise(none),
            "hex": F.when(text.rlike(r"[0-9a-f]{32}"), _spans(text, HEX, 1, 32)).otherwise(none),
        }
    )


def train(docs: DataFrame, sample_docs: int = 4000, smoothing: float = 0.5, prior: float = 20.0) -> MarkovPair:
    """Train both models on the texts of the ``sample_docs`` documents that come first in hashed id order.

    Only bigram counts, at most 128 x 128 a model, reach the driver. A bigram's
    share leans on its second character's with weight ``prior``; the random
    model's characters are half observed and half uniform over letters, digits
    and ``+/_=-``, so that it needs no secret to be found.
    """
    pick = docs.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs)
    text = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(pick), "doc_id").select("text")
    secret = F.concat(F.regexp_extract_all("text", F.lit(ASSIGN), F.lit(2)), F.regexp_extract_all("text", F.lit(ACCESS), F.lit(1)), F.regexp_extract_all("text", F.lit(HEX), F.lit(1)))
    ordinary = F.regexp_extract_all(F.regexp_replace("text", f"{ASSIGN}|{ACCESS}|[0-9a-f]{{32,}}", " "), F.lit(r"([A-Za-z0-9+/_=-]{4,})"), F.lit(1))
    tokens = text.select(F.explode(F.filter(secret, lambda x: F.length(x) >= 16)).alias("token"), F.lit(1).alias("random"))
    plain = F.filter(ordinary, lambda x: F.length(x) < LEAST)
    tokens = tokens.union(text.select(F.explode(plain).alias("token"), F.lit(0).alias("random")))
    chars = tokens.select("random", F.transform(F.split("token", ""), lambda c: F.ascii(c)).alias("c")).where(F.size("c") > 1)
    pairs = chars.select("random", F.explode(F.transform(F.sequence(F.lit(1), F.size("c") - 1), lambda i: F.get("c", i - 1) * ALPHABET + F.get("c", i))).alias("pair"))
    counts = pairs.groupBy("random", "pair").agg(F.count("*").alias("n")).collect()
    legal = [ord(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"]
    logs = []
    for label, flat in ((1, 0.5), (0, 0.0)):
        n = {r.pair: r.n for r in counts if r.random == label}
        single = {b: sum(n.get(a * ALPHABET + b, 0) for a in legal) + smoothing for b in legal}
        total = sum(single.values())
        back = {b: flat / len(legal) + (1 - flat) * single[b] / total for b in legal}
        table = [0.0] * (ALPHABET * ALPHABET)
        for a in legal:
            held = sum(n.get(a * ALPHABET + b, 0) for b in legal)
            for b in legal:
                table[a * ALPHABET + b] = math.log((n.get(a * ALPHABET + b, 0) + prior * back[b]) / (held + prior))
        logs.append(table)
    return MarkovPair(tuple(r - o for r, o in zip(*logs)))


def scan(docs: DataFrame, model: MarkovPair | None = None) -> DataFrame:
    """docs with spans: array<struct<start, kind_no, end>> sorted, kinds numbered as in ``KINDS``.

    Offsets are code points of the whole text, end exclusive. Kinds of the
    fixed patterns may overlap one another; a random token stands beside those
    it contains or overlaps, unless one of them covers it whole. A null text counts as empty. Columns of docs
    named spans, assign, access or hex are replaced; other columns and every
    row are passed on.
    """
    text = F.coalesce("text", F.lit(""))
    out = base_spans(docs)
    numbered = lambda name, no: F.transform(name, lambda s: F.struct(s["start"].alias("start"), F.lit(no).alias("kind_no"), s["end"].alias("end")))
    out = out.withColumn("_base", F.concat(*[numbered(k, i) for i, k in enumerate(KINDS[:3])]))
    if model is None:
        return out.withColumn("spans", F.sort_array("_base")).drop("_base")
    out = out.withColumn("_long", _spans(text, TOKEN, 1, LEAST))
    # of the spans in order, with base ones first, a token goes if one before it ends no sooner
    order = lambda name, no: F.transform(name, lambda s: F.struct(s["start"].alias("start"), F.lit(no).alias("token"), s["end"].alias("end"), (s["hit"] if no else F.lit("")).alias("hit")))
    both = F.sort_array(F.concat(order("_base", 0), order("_long", 1)))

    def free(reach: Column, s: Column) -> tuple[Column, Column]:
        kept = (s["token"] == 1) & (s["end"] > reach)
        return F.when(s["token"] == 1, reach).otherwise(F.greatest(reach, s["end"])), F.when(kept, F.struct(s["start"].alias("start"), s["end"].alias("end"), s["hit"].alias("hit")))

    none = F.array().cast("array<struct<start:int,end:int,hit:string>>")
    alone = F.when((F.size("_base") > 0) & (F.size("_long") > 0), _running(both, none, free)).otherwise(F.col("_long"))

    def random(span: Column) -> Column:
        score = model.column(span["hit"])
        return (score >= model.total) & (score >= model.per_char * F.least(F.length(span["hit"]) - 1, F.lit(model.most)))

    out = out.withColumn("_alone", alone).withColumn("_random", F.filter("_alone", random))
    return out.withColumn("spans", F.sort_array(F.concat("_base", numbered("_random", 3)))).drop("_base", "_long", "_alone", "_random")


def describe(spans: Column) -> Column:
    """kind:start:end of every span, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind_no"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(text: Column, spans: Column, mark: str = "[SECRET]", piece: int = 4096) -> Column:
    """text with every run of overlapping spans replaced by mark; what is kept is read from pieces of the text."""
    none = F.array().cast("array<struct<low:int,high:int>>")

    def gap(pos: Column, s: Column) -> tuple[Column, Column]:
        return F.greatest(pos, s["end"]), F.when(s["start"] >= pos, F.struct(pos.alias("low"), s["start"].alias("high")))

    pieces = F.regexp_extract_all(text, F.lit(f"(?s)(.{{1,{piece}}})"), F.lit(1))
    gaps = F.array_append(_running(spans, none, gap), F.struct(F.array_max(F.transform(spans, lambda s: s["end"])).alias("low"), F.length(text).alias("high")))

    def kept(pieces: Column, g: Column) -> Column:
        first, last = F.floor(g["low"] / piece).cast("int"), F.floor(g["high"] / piece).cast("int")
        return F.substring(F.array_join(F.slice(pieces, first + 1, last - first + 1), ""), g["low"] - first * piece + 1, g["high"] - g["low"])

    cut_up = F.transform(F.array(F.struct(pieces.alias("pieces"), gaps.alias("gaps"))), lambda x: F.array_join(F.transform(x["gaps"], lambda g: kept(x["pieces"], g)), mark))
    return F.when(F.size(spans) > 0, F.get(cut_up, F.lit(0))).otherwise(text)


def secrets(docs: DataFrame, sample_docs: int = 4000) -> DataFrame:
    """Per row of docs(doc_id, text): doc_id, n_assign, n_access, n_hex, n_random, base_sha256, spans."""
    found = scan(docs.select("doc_id", "text"), train(docs.select("doc_id", "text"), sample_docs))
    base = F.filter("spans", lambda s: s["kind_no"] < 3)
    count = lambda name: F.size(name).cast("long").alias(f"n_{name}")
    n_random = (F.size("spans") - F.size(base)).cast("long").alias("n_random")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), n_random, F.sha2(describe(base), 256).alias("base_sha256"), describe(F.col("spans")).alias("spans"))
