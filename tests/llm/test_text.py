import base64
import itertools
import math
import os
from collections import Counter

import numpy as np
import pandas as pd
import pytest

from histospark.llm import bpe, mix, spam

tiktoken = pytest.importorskip("tiktoken")
if not os.path.exists(bpe.VOCABULARY):
    pytest.skip("no vocabulary files here", allow_module_level=True)

TRICKY = [None, "", " ", "a", "<|endoftext|>", "x" * 700, "!?" * 400, "é" * 300 + "\r\n\r\n  　y", "\n" * 300 + "z", "It's 9 o'clock,\tWE'LL see's", "a\x85b\xa0c​d﻿", "日本語 テキスト。", "퟿\U0001f642\U0001f642", "00:00:01,000 --> 00:00:02.500\nHi", "1\n00:00:01,000 --> 00:00:02,500\nHi there\n\n2\n00:00:03,000 --> 00:00:04,000\nHi there\n"]


@pytest.fixture(scope="module")
def oracle():
    with open(bpe.VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_encoder_equals_reference(oracle):
    rng = np.random.default_rng(1)
    letters = [chr(c) for c in range(1, 0x250)] + list(" \n\n  '’éüßñ日語नमः🙂") * 12
    texts = TRICKY + ["".join(rng.choice(letters, n)) for n in rng.integers(1, 80, 1500)]
    flat, at = bpe.Encoder(open(bpe.VOCABULARY, "rb").read()).encode(texts)
    for i, t in enumerate(texts):
        assert flat[at[i] : at[i + 1]].tolist() == (oracle.encode_ordinary(t) if t else []), repr(t)


def test_long_words_equal_matrix():
    v = bpe.Vocabulary(open(bpe.VOCABULARY, "rb").read())
    words = [w.encode() for w in ("internationalization" * 3, "aaaaaaaaaaaaa", "abcabcabd" * 7, "-----=====")]
    assert all((a == v._merge_long(w)).all() for a, w in zip(v.merge(words), words))


def test_encode_table(spark, oracle):
    df = spark.createDataFrame([(i, t, "s") for i, t in enumerate(TRICKY + TRICKY)], "doc_id bigint, text string, ids string")
    got = {r.doc_id: r.ids for r in bpe.encode(df).collect()}
    assert got == {i: oracle.encode_ordinary(t) if t else [] for i, t in enumerate(TRICKY + TRICKY)}
    assert bpe.encode(df.limit(0)).count() == 0


def test_words_of_a_page():
    text = "WEBVTT\r\n\r\n1\r\n00:00:01.000 --> 00:00:02.000\r\n<i>Hello</i> {\\an8}there​!\r\n\r\n2\n00:00:03,000 --> 00:00:04,000\nB u y  n o w  \n"
    assert spam.plain_lines(text) == "webvtt\nhello there!\nb u y  n o w"
    assert spam.plain_lines("Приве́т".encode().decode("latin-1")) == "приве́т"
    assert spam.repaired("Où est l'échelle ?", "fr") == "Où est l'échelle ?"
    t = spam.Tokens()
    assert t.of("b u y n o w") == [spam.SPACED] and t.of("x1 7\ny2") == [t.of("x9")[0], spam.NUMBER, 0, t.of("z3")[0]]


def ratio(body):
    lengths, sizes = spam.block_sizes(body)
    assert sum(lengths) == len(body)
    return sum(sizes) / sum(lengths)


def test_blocks_read_the_tail():
    rng = np.random.default_rng(3)
    letters = lambda n: "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz "), n))
    for n in (spam.BLOCK, 3 * spam.BLOCK):
        varied = letters(n)
        tail = letters(spam.BLOCK // 2)
        assert ratio(varied + "ab" * (spam.BLOCK // 4)) < 0.95 * ratio(varied + tail)
    block = letters(spam.BLOCK)
    assert abs(ratio(block * 2) - ratio(block)) < 1e-9 and ratio("a") > 0


def speech(rng, n):
    a, b, c = ["the captain", "my sister", "nobody here", "a stranger", "your lawyer"], ["sold the boat", "knows the way", "heard the bell", "told me all", "fears the storm"], ["before dawn", "by the pier", "for no reason", "after supper", "again"]
    return "\n".join(f"{rng.choice(a)} {rng.choice(b)} {rng.choice(c)}{rng.choice(['.', '!', '?'])}" for _ in range(n))


def keywords(rng, n):
    k = ["cheap lamp", "slim tea", "movie download", "running shoes", "loan fast"]
    chosen = rng.choice(k, 3)
    return "\n".join(rng.choice([" | ", ", "]).join(rng.choice(chosen, rng.integers(2, 6))) for _ in range(n))


def test_list_pages(spark):
    rng = np.random.default_rng(5)
    song = "\n".join("♪ carry me home, carry me home ♪" for _ in range(30))
    rows = [(i, speech(rng, 40), "en") for i in range(120)] + [(200 + i, keywords(rng, 30), "en") for i in range(12)]
    mostly = keywords(rng, 30) + "\n" + speech(rng, 4)
    barely = speech(rng, 40) + "\n" + keywords(rng, 3)
    rows += [(300, song, "en"), (301, None, None), (302, "", "en"), (303, " \n ", None), (304, mostly, None), (305, barely, "EN"), (306, "Hi.", "en"), (200, rows[120][1], "en")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    assert {r.doc_id for r in spam.list_pages(df).collect()} == set(range(200, 212)) | {304}
    assert spam.list_pages(df.limit(0)).count() == 0


def test_pages_of_unknown_words(spark):
    rng = np.random.default_rng(6)
    rows = [(i, speech(rng, 40), "en") for i in range(120)] + [(200 + i, keywords(rng, 30), "en") for i in range(12)]
    rows += [(300, "\n".join(["zorblax quimfep drovnik"] * 30), "en"), (301, "\n".join(["Vexlorn humpetik gravdosh!"] * 30), "en"), (302, "wubblen kritsof", "en")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    # words of a single document are never in the lexicon
    assert {r.doc_id for r in spam.list_pages(df).collect()} == set(range(200, 212)) | {300}


def test_usual_ratio():
    bins = np.arange(20, 30)
    x = bins / spam.STEPS
    medians = pd.concat([pd.DataFrame({"script": s, "lang": lang, "bin": bins, "n": 1000, "y": a - 0.2 * x}) for s, lang, a in (("0", "en", 1.0), ("0", "de", 1.3), ("5", "ar", 0.5))])
    usual = spam.Usual(medians)
    level = {(s, lang): c0 + c1 * (8 - usual.middle) + c2 * (8 - usual.middle) ** 2 for s, lang, c0, c1, c2 in usual.rows}
    assert abs(level["0", "en"] + 0.6) < 0.03 and abs(level["0", "de"] + 0.3) < 0.03 and abs(level["5", "ar"] + 1.1) < 0.03
    # a language of one block is taken for its script's
    few = spam.Usual(pd.concat([medians, pd.DataFrame({"script": "0", "lang": "xx", "bin": [24], "n": 1, "y": 9.0})]))
    assert abs({r[:2]: r[2] for r in few.rows}["0", "xx"] - np.mean([{r[:2]: r[2] for r in few.rows}["0", k] for k in ("en", "de")])) < 0.5
    assert spam.Usual(medians.iloc[:0]).rows == []


DOCS = "doc_id bigint, text string, source string, n_tokens string"
TARGETS = "source string, target_share double, max_repeats int, blocks string"


def test_permutation_and_counts():
    for size in (1, 2, 3, 10, 257, 1000):
        there = mix.permuted(np.arange(size), size, 5)
        assert sorted(there) == list(range(size)) and (mix.permuted(there, size, 5, True) == np.arange(size)).all()
    totals = [50, 0, 333, 17]
    tree = mix.Shards(totals, 64, 3)
    counts, before = zip(*(tree.counts(s) for s in range(7)))
    assert (np.sum(counts, 0) == totals).all() and [sum(c) for c in counts] == [64] * 6 + [16]
    assert (np.cumsum([np.zeros(4, int), *counts[:-1]], axis=0) == before).all()


@pytest.mark.parametrize("good,bad,n", [(7, 5, 4), (5, 7, 9), (40, 3, 21), (1, 1, 1), (300, 500, 600)])
def test_hypergeometric_is_exact(good, bad, n):
    rng = np.random.default_rng(1)
    size = 20_000
    seen = Counter(mix.hypergeometric(good, bad, n, rng) for _ in range(size))
    assert sum(abs(seen[k] / size - math.comb(good, k) * math.comb(bad, n - k) / math.comb(good + bad, n)) for k in range(max(0, n - bad), min(good, n) + 1)) < 0.06
    assert min(seen) >= max(0, n - bad) and max(seen) <= min(good, n)


def test_hypergeometric_of_huge_numbers():
    rng = np.random.default_rng(2)
    good, bad, n = 6 * 10**13, 10**14, 3 * 10**12
    x = np.array([mix.hypergeometric(good, bad, n, rng) for _ in range(4000)], float) - n * 0.375
    sd = math.sqrt(n * 0.375 * 0.625 * (1 - n / (good + bad)))
    assert abs(x.mean() / sd) < 0.08 and abs(x.std() / sd - 1) < 0.05
    assert mix.hypergeometric(good, 0, n, rng) == n and mix.hypergeometric(0, bad, n, rng) == 0 and mix.hypergeometric(good, bad, good + bad, rng) == good


def test_mixture(spark):
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(rng.choice(["red", "fox", "runs", "far"], rng.integers(1, 60))), s, "x") for i, s in enumerate(itertools.chain(["big "] * 150, ["Small"] * 12, [None] * 5, ["untargeted"] * 9, ["\tsmall"] * 3))]
    rows += [(1000, None, "big", "x"), (1001, "", "small", "x"), (1002, "fox " * 3000, "big", "x")]
    documents = spark.createDataFrame(rows, DOCS).repartition(5)
    targets = spark.createDataFrame([("big", 0.6, 1, "y"), ("SMALL ", 0.3, 3, "y"), ("absent", 0.1, 2, "y"), (None, 0.5, 1, "y")], TARGETS)
    asked = mix.asked(targets)
    ids = {r.doc_id: r.ids for r in bpe.encode(documents).collect()}
    pieces = mix.packed(documents, [a[0] for a in asked], block=16)
    sources, total = mix.plan(pieces, asked, block=16)
    assert total == sum(map(len, ids.values())) and [s.name for s in sources] == ["absent", "big", "small"]
    small = sources[2]
    assert small.documents == 16 and small.tokens * 3 == small.quota and sources[0].slots == 0
    assert sum(s.quota for s in sources) == min(total, sum(s.tokens * s.repeats for s in sources))
    held = {(r.source_no, r.block_index): r for r in mix.blocks(pieces, sources, block=16).collect()}
    covered = {}
    for (s, b), r in held.items():
        assert len(r.ids) == (16 if b < sources[s].blocks - 1 else sources[s].tokens - 16 * b)
        assert r.ids == [t for x in r.spans for t in ids[x.doc_id][x.from_token : x.to_token]]
        for x in r.spans:
            covered.setdefault(x.doc_id, []).append((x.from_token, x.to_token))
    assert set(covered) == {d for d, _, s, _ in rows if s and s.strip().lower() in ("big", "small") and ids[d]}
    for doc, parts in covered.items():
        parts.sort()
        assert parts[0][0] == 0 and parts[-1][1] == len(ids[doc]) and all(a[1] == b[0] for a, b in zip(parts, parts[1:]))
    used = mix.slots(spark, sources, block=16, shard=7).collect()
    assert len(used) == sum(s.slots for s in sources) == len({(r.source_no, r.repeat, r.block_index) for r in used})
    assert all(r.repeat < sources[r.source_no].repeats and 0 < r.n_tokens <= len(held[r.source_no, r.block_index].ids) for r in used)
    assert len({(r.shard, r.position) for r in used}) == len(used)
    for i, s in enumerate(sources):
        assert sum(r.n_tokens for r in used if r.source_no == i) == s.quota
    whole = mix.packed(documents, [a[0] for a in asked])
    sources, _ = mix.plan(whole, asked)
    mixed = mix.mixture(whole, sources).collect()
    assert all(len(r.ids) == r.n_tokens for r in mixed) and sum(r.n_tokens for r in mixed) == sum(s.quota for s in sources)
    report = {r.source: r for r in mix.report(spark, sources, total).collect()}
    assert set(report) == {"absent", "big", "small"} and abs(sum(r.actual_share for r in report.values()) - 1) < 1e-9 and report["absent"].tokens_used == 0
    empty = mix.packed(documents.limit(0), [a[0] for a in asked])
    none, zero = mix.plan(empty, asked)
    assert zero == 0 and mix.mixture(empty, none).count() == 0 and mix.report(spark, none, 0).count() == 3
    nothing, all_ = mix.plan(whole, mix.asked(targets.limit(0)))
    assert all_ == total and mix.mixture(whole, nothing).count() == 0
