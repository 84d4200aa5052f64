"""Encoding, mixing, shared spans."""

from __future__ import annotations

import base64
import os
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from linkwright.llm import tokens
from linkwright.llm.mixing import actual_shares, mixture, plan_mixture
from linkwright.llm.spans import shared_portion, shared_spans
from linkwright.llm.tokens import DEFAULT_DIR, count_tokens, decode_ids, encode_corpus

TEXTS = ["", None, " ", "Hello, world!\n\n1\n00:01:02,345 --> 00:01:04,000\n", "it's  we'll 'should \r\n\tx", "日本語のテキスト、ÅÄÖ ½²٣", "<|endoftext|> a", "﻿\u0000\x1c\x85　 x​", "a" * 900, "日" * 400, " " * 500 + "z", "é" * 2 + "퟿", "x\n \n\n y"]


def _reference():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(f"{DEFAULT_DIR}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return lambda x: t.encode(x or "", add_special_tokens=False).ids


needs_files = pytest.mark.skipif(not os.path.exists(f"{DEFAULT_DIR}/byte_bpe_50k.json"), reason="no vocabulary")


@needs_files
def test_encoding(spark):
    reference = _reference()
    rng = random.Random(2)
    texts = TEXTS + ["".join(rng.choice("ab' sStTre\n\r é日1²_-<|>0") for _ in range(rng.randrange(60))) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("ids", F.lit("clash"))
    got = {r["doc_id"]: r["ids"] for r in encode_corpus(df).collect()}
    assert all(got[i] == reference(t) for i, t in enumerate(texts))
    assert decode_ids(got[3]) == texts[3] and got[0] == got[1] == []
    counts = {r["doc_id"]: r["n_tokens"] for r in count_tokens(df).collect()}
    assert counts == {i: len(x) for i, x in got.items()}
    assert encode_corpus(df.where("doc_id < 0")).count() == 0
    with pytest.raises(ValueError):
        count_tokens(df.withColumnRenamed("ids", "n_tokens"))


@needs_files
def test_long_words_are_merged_alike():
    tiktoken = pytest.importorskip("tiktoken")
    with open(f"{DEFAULT_DIR}/byte_bpe_50k.tiktoken", "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    other = tiktoken.Encoding("own", pat_str=tokens._WORDS, mergeable_ranks=ranks, special_tokens={})
    encoder = tokens.Encoder.of(f"{DEFAULT_DIR}/byte_bpe_50k.json")
    rng = random.Random(3)
    made = ["".join(rng.choice("abcdeéтж日") for _ in range(n)) for n in (3, 40, 90, 130)]
    for w in made:
        assert encoder._merge_long(w) == dict(encoder._merge_words([w]))[w] == other.encode_ordinary(w)


def test_plan():
    plan = plan_mixture({"a": 100, "b": 10, "c": 5}, {"a": (0.5, 1), "b": (0.4, 4), "d": (0.1, 3), "c": (0.0, 2)})
    assert set(plan) == {"a", "b"} and plan["b"]["rate"] == pytest.approx(4)
    assert plan["a"]["rate"] * 100 / (plan["b"]["rate"] * 10) == pytest.approx(0.5 / 0.4)
    full = plan_mixture({"a": 100, "b": 10}, {"a": (0.5, 2), "b": (0.5, 2)}, total=100)
    assert full["b"]["rate"] == 2 and full["a"]["rate"] == pytest.approx(0.8)
    assert plan_mixture({"a": 10}, {"a": (1.0, 2)}, total=10**6)["a"]["rate"] == 2
    assert plan_mixture({}, {"a": (1.0, 1)}) == {} and plan_mixture({}, {"a": (1.0, 1)}, total=5) == {}


def test_mixture(spark):
    rng = random.Random(6)
    rows = [(i, rng.choice("aaaaaabbc"), rng.randrange(0, 400)) for i in range(3000)] + [(5000, None, 5), (5001, "a", None)]
    df = spark.createDataFrame(rows, "id long, source string, n long").withColumn("rate", F.lit("clash"))
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 2), ("c", 0.15, 3), ("none", 0.1, 2)], "source string, target_share double, max_repeats int")
    mixed = mixture(df, targets, "id", "source", "n")
    copies = defaultdict(int)
    for r in mixed.collect():
        copies[r["id"]] += 1
    source = {i: s for i, s, n in rows if n}
    seen = defaultdict(set)
    for i, s in source.items():
        if s:
            seen[s].add(copies[i])
    assert all(max(x) - min(x) <= 1 and max(x) <= {"a": 1, "b": 2, "c": 3}[s] for s, x in seen.items())
    report = {r["source"]: r for r in actual_shares(mixed, df, targets, "source", "n").collect()}
    assert set(report) == {"a", "b", "c", "none"} and report["none"]["actual_share"] == 0
    for s, share in (("a", 0.5), ("b", 0.3), ("c", 0.15)):
        assert report[s]["actual_share"] == pytest.approx(share / 0.95, abs=0.004)
    again = mixture(df.repartition(7), targets, "id", "source", "n")
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, mixed.collect()))
    assert mixture(df.where("id < 0"), targets, "id", "source", "n").count() == 0


def _brute(docs, k):
    held = defaultdict(set)
    for i, t in docs:
        for p in range(len(t) - k + 1):
            held[t[p : p + k]].add(i)
    out = set()
    for i, t in docs:
        mark = [False] * len(t)
        for p in range(len(t) - k + 1):
            if len(held[t[p : p + k]]) > 1:
                mark[p : p + k] = [True] * k
        p = 0
        while p < len(t):
            q = p
            while q < len(t) and mark[q]:
                q += 1
            if q > p:
                out.add((i, p, q))
            p = max(q, p + 1)
    return out


@pytest.mark.parametrize(("k", "seed"), [(20, 1), (40, 2), (10, 3)])
def test_spans_are_exact(spark, k, seed):
    rng = random.Random(seed)
    word = lambda n: "".join(rng.choice("ab é😀\n") for _ in range(n))
    parts = [word(rng.randrange(5, 90)) for _ in range(14)]
    docs = [(i, "".join(rng.choice(parts) if rng.random() < 0.5 else word(rng.randrange(1, 50)) for _ in range(rng.randrange(0, 9)))) for i in range(30)]
    docs += [(100, "ab" * 60), (101, "x" + "ab" * 25), (102, "q" * 90), (103, docs[3][1]), (104, "z" * (k - 1)), (105, ""), (106, None), (107, "q" * (k - 1) + "z")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("s", F.lit(1)).repartition(3)
    spans = shared_spans(df, min_chars=k)
    got = [tuple(r) for r in spans.collect()]
    assert len(got) == len(set(got)) and set(got) == _brute([(i, t) for i, t in docs if t], k)
    part = {r["doc_id"]: r for r in shared_portion(df, spans).collect()}
    assert len(part) == len(docs) and part[105]["shared_part"] == part[106]["shared_part"] == 0
    assert part[103]["shared_chars"] == sum(b - a for i, a, b in got if i == 103)


@pytest.mark.parametrize("bits", [2, 6])
def test_spans_with_colliding_hashes(spark, monkeypatch, bits):
    """Hashes of a few bits take unequal texts for equal ones; the texts themselves tell, and other hashes are taken."""
    from linkwright.llm import spans

    tried = []
    differ = spans._differ
    monkeypatch.setattr(spans, "_differ", lambda *x: tried.append(differ(*x)) or tried[-1])
    rng = random.Random(5)
    parts = ["".join(rng.choice("abcde") for _ in range(rng.randrange(30, 90))) for _ in range(12)]
    docs = [(i, "".join(rng.choice(parts) + rng.choice("xyz") * rng.randrange(3) for _ in range(6))) for i in range(20)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert {tuple(r) for r in shared_spans(df, min_chars=30, hash_bits=bits).collect()} == _brute(docs, 30)
    assert tried == [True, False]


def test_paths_are_compacted_between_branches(spark):
    """a-b-c is found twice and c-d once more: one path ends where the third record comes in."""
    from linkwright.llm.spans import compact_paths

    edges = {"a": (0, 9), "b": (10, 19), "c": (20, 29), "d": (30, 39)}
    rows = [(doc, *edges[x], edges[x][1] + 5, ord(x), ord(x), n, lo, edges[x][0]) for x, n, lo, docs in (("a", 2, 1, (1, 2)), ("b", 2, 1, (1, 2)), ("c", 3, 1, (1, 2, 3)), ("d", 3, 1, (1, 2, 3))) for doc in docs]
    df = spark.createDataFrame(rows, "doc long, s int, e int, b int, v long, eid long, n long, lo long, at int")
    got = {tuple(r) for r in compact_paths(df).collect()}
    assert got == {(d, *x, 1, x[0]) for d in (1, 2) for x in ((0, 24), (20, 44))} | {(3, 20, 44, 1, 20)}


def test_spans_of_pieces(spark, monkeypatch):
    """Texts longer than a piece are cut without losing windows."""
    from linkwright.llm import spans

    rng = random.Random(8)
    common = "".join(rng.choice("abcdefgh") for _ in range(300))
    docs = [(1, "".join(rng.choice("xyz") for _ in range(700)) + common), (2, common + "!" * 100), (3, "w" * 400)]
    texts = [t for _, t in docs]
    monkeypatch.setattr(spans, "PIECE", 100)
    whole = set()
    for codes, number, where in spans._pieces(texts, 50):
        first, last, _, at, *_ = spans.edges_of(codes, number, 50, 20, spans._BASES[0])
        assert ((at >= first) & (at <= first + 49)).all()
        for f, e in zip(first, last):
            text, shift = where[number[f]]
            whole |= {(int(text), int(p + shift)) for p in range(f, e + 1)}
    assert whole == {(i, p) for i, t in enumerate(texts) for p in range(len(t) - 49)}


def test_spans_of_nothing(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert shared_spans(df).count() == 0 and shared_portion(df, shared_spans(df)).count() == 0
