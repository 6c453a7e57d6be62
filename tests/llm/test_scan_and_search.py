"""WARC archives, lexical search and token alignment against brute force, and on odd input."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import pytest

sentencepiece = pytest.importorskip("sentencepiece")

import numpy as np

from cairngraph.llm import alignment, lexical, warc
from cairngraph.llm.queries import BYTE_BPE, MODEL

INNER = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
BIG = "x" * 200


def pages():
    out = [(1, "http://a", BIG), (2, "http://b", BIG), (3, None, None), (4, "u\r\nWARC/1.1\r\nContent-Length: 0\r\n\r\n", "short"), (5, "WARC/1.1", INNER * 3), (6, "q", INNER * 3)]
    out += [(7, "q", "\r\n\r\n" + INNER + "\r\n\r\n"), (8, "x", "short"), (None, "x", BIG), (9, "é", "é" * 300 + "\nWARC/1."), (10, "x", "\nWARC/1.0\r\nContent-Length: 100000\r\n\r\n" + "y" * 50)]
    out += [(2, "http://b", BIG), (1, "z", BIG), (-5, "neg", "\r\n" * 500), (11, "neg", "\r\n" * 500), (None, "n", "z" * 120), (None, "n", "z" * 120), (12, "", ""), (13, None, "w" * 99), (14, None, "w" * 99)]
    return out + [(100 + i, f"http://{i}", ("\nWARC/1.1\r\nContent-Length: %d\r\n\r\n" % (i * 37 % 400)) * (i % 7) + "p" * (i * 13 % 900)) for i in range(60)]


def archived(rows):
    """What reading back should give, one row after the other."""
    first = {}
    for page, _, text in rows:
        if page is not None and len((text or "").encode()) >= 100:
            first[text] = min(first.get(text, page), page)
    out = []
    for page, _, text in rows:
        body, to = (text or "").encode(), first.get(text)
        again = to is not None and page != to
        out.append((page, len(body), hashlib.sha256(body).hexdigest(), "revisit" if again else "response", to if again else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [None, "4k"])
def test_archives_give_back_what_was_written(spark, block):
    df = spark.createDataFrame([(*r, "other") for r in pages()], "page_id long, url string, html string, digest string")
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    if block:
        spark.conf.set("spark.sql.files.maxPartitionBytes", block)
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        got = sorted((tuple(r) for r in warc.archived(df.repartition(2)).collect()), key=str)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == archived(pages())


def test_archives_of_no_pages(spark):
    assert warc.archived(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_only_what_the_chain_reaches_is_a_record(spark, tmp_path):
    record = lambda body, kind="resource": f"WARC/1.0\r\nWARC-Type: {kind}\r\nContent-Length: {len(body)}\r\n\r\n{body}\r\n\r\n"
    (tmp_path / "good.warc").write_bytes((record("abc") + record("\r\n\r\n" + record("inner")) + record("", "warcinfo")).encode())
    (tmp_path / "broken.warc").write_bytes((record("one") + "junk\r\n" + record("lost")).encode())
    (tmp_path / "preface.warc").write_bytes(("hello\r\n" + record("lost")).encode())
    (tmp_path / "cut.warc").write_bytes((record("whole") + record("cut off")[:-9]).encode())
    (tmp_path / "empty.warc").write_bytes(b"")
    got = warc.read_archives(spark, str(tmp_path)).collect()
    found = defaultdict(list)
    for r in sorted(got, key=lambda r: r.offset):
        found[r.file.rsplit("/", 1)[1]].append((r.payload_bytes, r.digest))
    of = lambda *bodies: [(len(b), hashlib.sha256(b.encode()).hexdigest()) for b in bodies]
    assert found == {"good.warc": of("abc", "\r\n\r\n" + record("inner"), ""), "broken.warc": of("one"), "cut.warc": of("whole")}


def test_pointer_jumping_crosses_many_blocks(spark):
    rng, at, chain, rows = random.Random(1), 0, [], []
    for _ in range(300):
        step = rng.randint(5, 60)
        chain.append(at)
        rows.append(("f", at // 100, at, at + step))
        rows += [("f", (at + k) // 100, at + k, at + k + rng.randint(1, 200)) for k in rng.sample(range(1, step), min(2, step - 1))]
        at += step
    got = warc._proved(spark.createDataFrame(rows, "file string, block long, offset long, after long"))
    assert sorted(r.offset for r in got.collect()) == chain


WORDS = [f"w{n}" for n in range(30)] + ["Ünïcode", "7", "naïve"]
TERM = re.compile(lexical.TERM)


def lexical_corpus():
    rng = random.Random(6)
    docs = [(n, " ".join(rng.choices(WORDS, [1 / (k + 1) for k in range(len(WORDS))], k=rng.choice([1, 5, 40, 300])))) for n in range(120)]
    docs += [(300 + n, docs[3][1]) for n in range(15)] + [(500, None), (501, ""), (502, " .,- "), (None, docs[3][1]), (3, docs[3][1]), (503, "W1-w1_W2\x00w3 ünïcode ÜNÏCODE")]
    items = [(n, ", ".join(rng.sample(WORDS, rng.randint(1, 9))).upper()) for n in range(25)] + [(90, None), (91, "nowhere"), (92, "w1 w1 W1"), (None, "w5 w6"), (93, "Ünïcode"), (92, "w9")]
    return docs, items


def ranked(docs, items, k):
    fold = str.maketrans(lexical.UPPER, lexical.LOWER)
    cut = lambda t: TERM.findall((t or "").translate(fold))
    bags = [(i, Counter(cut(t))) for i, t in docs]
    n_docs, length = sum(1 for _, b in bags if b), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    wanted = defaultdict(set)
    for i, t in items:
        wanted[i] |= set(cut(t))
    out = []
    for item, terms in wanted.items():
        scored = []
        for doc, bag in bags:
            m = 100 - 90 + (90 * sum(bag.values()) * n_docs) // length
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * bag[t]) // (1000 * bag[t] + 8 * m)) for t in terms if bag[t])
            if score > 0:
                scored.append((-score, doc is None, doc))
        out += [(item, r + 1, doc, -s) for r, (s, _, doc) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize("k,at_once", [(10, lexical.TERMS), (3, 40)])
def test_search_equals_scoring_every_document(spark, monkeypatch, k, at_once):
    docs, items = lexical_corpus()
    frame = lambda rows, key: spark.createDataFrame([(*r, 7) for r in rows], f"{key} long, text string, score long")
    got = lexical.search(frame(docs, "doc_id").repartition(3), frame(items, "item_id"), k, at_once)
    assert sorted((tuple(r) for r in got.collect()), key=str) == ranked(docs, items, k)


def test_search_drops_items_before_the_leaves():
    rng = random.Random(3)
    docs = 600
    starts, ranks, tfs = [0], [], []
    for _ in range(docs):
        held = sorted(rng.sample(range(40), rng.randint(3, 12)))
        ranks += held
        tfs += [rng.randint(1, 4) for _ in held]
        starts.append(len(ranks))
    m, weights = np.array([rng.randint(60, 400) for _ in range(docs)]), np.array([500 + 100 * n for n in range(40)])
    starts, ranks, tfs = np.array(starts), np.array(ranks), np.array(tfs)
    items = [np.array(sorted(rng.sample(range(40), 5))) for _ in range(6)]
    search, opened = lexical.Search(items, 40, 10), []
    inner = search._offer
    search._offer = lambda item, score, doc: (opened.append((item, doc)), inner(item, score, doc))
    search.visit(lexical.Tree(list(range(docs)), m, starts, ranks, tfs, weights))
    assert len(opened) < 0.6 * docs * len(items)
    for n, terms in enumerate(items):
        scores = [(-sum(int(lexical.gain(weights[r], int(f), m[d])) for r, f in zip(ranks[starts[d] : starts[d + 1]], tfs[starts[d] : starts[d + 1]]) if r in terms), d) for d in range(docs)]
        assert sorted((-s, -x) for s, _, x in search.best[n]) == sorted(scores)[:10]


def test_search_without_rows(spark):
    docs, items = (spark.createDataFrame([], f"{key} long, text string") for key in ("doc_id", "item_id"))
    some = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert lexical.search(docs, items).count() == lexical.search(some, items).count() == 0
    assert lexical.search(docs, some.withColumnRenamed("doc_id", "item_id")).count() == 0


TEXTS = ["", None, "a", "Hello  world\n\n don't", "naïve café 東京 \U0001f600", "▁ is taken", "<|endoftext|> and <s>", "x" * 700, " " * 600 + "y", "the the the", "same text here", "same text here", "\x00\x01", "tab\tnew\r\nline", "über " * 300]


def aligned(texts):
    """Spans of both tokenizers, all pairs tried."""
    by = alignment.Aligner(BYTE_BPE, MODEL)
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(BYTE_BPE)
    own.encode_special_tokens = True
    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    out, held = [], defaultdict(set)
    for n, text in enumerate(texts):
        source = (" " + (text or "")).encode()
        ids = own.encode(" " + (text or ""), add_special_tokens=False).ids, model.encode(text or "")
        spans = []
        for side, names in zip(ids, (by.bytes_a, by.bytes_b)):
            at, part = 0, []
            for i in side:
                part.append((at, at + len(names[i]), i))
                at += len(names[i])
            spans.append(part)
        if not text or any(b"".join(names[i] for i in side) != source for side, names in zip(ids, (by.bytes_a, by.bytes_b))):
            spans = [[], []]
        a, b = spans
        links = [(x, y, min(x[1], y[1]) - max(x[0], y[0])) for x in a for y in b if x[0] < y[1] and y[0] < x[1]]
        for x, y, _ in links:
            held[x[2], y[2]].add(n)
        cuts = sorted({x[1] for x in a} & {y[1] for y in b})
        groups = [([x[2] for x in a if lo < x[1] <= hi], [y[2] for y in b if lo < y[1] <= hi]) for lo, hi in zip([0, *cuts], cuts)]
        out.append((a, b, links, groups))
    return out, {pair: len(docs) for pair, docs in held.items()}


@pytest.mark.parametrize("limit", [alignment.PAIRS, 10])
def test_alignment_equals_trying_all_pairs(spark, limit):
    want, count = aligned(TEXTS)
    top = defaultdict(int)
    for (a, _), n in count.items():
        top[a] = max(top[a], n)
    rows = [(n, t, 9) for n, t in enumerate(TEXTS)] + [(None, None, 9)]
    got = alignment.link_counts(spark.createDataFrame(rows, "doc_id long, text string, n_a long").repartition(3), BYTE_BPE, MODEL, limit).collect()
    assert len(got) == len(rows)
    for r in got:
        a, b, links, groups = want[r.doc_id] if r.doc_id is not None else ([], [], [], [])
        assert (r.n_a, r.n_b, r.n_groups, r.n_links) == (len(a), len(b), len(groups), len(links)), r.doc_id
        assert r.n_group_links == sum(len(x) * len(y) for x, y in groups)
        assert r.count_sum == sum(count[x[2], y[2]] for x, y, _ in links)
        assert r.n_best == sum(count[x[2], y[2]] == top[x[2]] for x, y, _ in links)
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        assert r.groups_sha256 == (hashlib.sha256(text.encode()).hexdigest() if text else "")
    assert sum(r.n_a > 0 for r in got) == len(TEXTS) - 3


def test_alignment_itself(spark):
    want, _ = aligned(TEXTS)
    got = alignment.alignment(spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string"), BYTE_BPE, MODEL).collect()
    for r in got:
        a, b, links, groups = want[r.doc_id]
        assert (r.a_ids, r.b_ids) == ([x[2] for x in a], [y[2] for y in b])
        assert [tuple(x) for x in r.links] == [(a.index(x), b.index(y), n) for x, y, n in links]
        ends = list(np.cumsum([[len(x), len(y)] for x, y in groups], axis=0)) if groups else []
        assert [tuple(x) for x in r.groups] == [tuple(x) for x in ends]
    assert alignment.link_counts(spark.createDataFrame([], "doc_id long, text string"), BYTE_BPE, MODEL).count() == 0


def test_products_of_sparse_matrices():
    rng = np.random.default_rng(5)
    for _ in range(30):
        n, k, m = rng.integers(1, 9, 3)
        dense = [(rng.random(s) < 0.4) * rng.integers(1, 5, s) for s in ((n, k), (k, m))]
        sparse = [alignment.Csr(np.concatenate([[0], np.cumsum((d > 0).sum(1))]), np.nonzero(d)[1], d[d > 0], d.shape[1]) for d in dense]
        for got, want in ((alignment.gustavson(*sparse), dense[0] @ dense[1]), (sparse[0].transposed(), dense[0].T)):
            full = np.zeros(want.shape, np.int64)
            full[got.row_of(), got.indices] = got.data
            assert (full == want).all() and (np.diff(got.indices)[np.diff(got.row_of()) == 0] > 0).all()


def test_both_libraries_cut_words_alike():
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(BYTE_BPE)
    own.encode_special_tokens = True
    encode, odd = alignment._byte_bpe(BYTE_BPE)[0], alignment._settled()
    chars = [chr(c) for c in range(0x10000) if not 0xD800 <= c < 0xE000]
    kept = [c for c in chars if not odd.search(c)]
    assert len(kept) > 50_000
    texts = [f"a{c}b {c}{c} 1{c}2  {c} \n{c}'{c}" for c in kept] + ["I'LL don't we've", "  two", "end  ", "\n\n \t x"]
    assert encode(texts) == [e.ids for e in own.encode_batch([" " + t for t in texts], add_special_tokens=False)]
