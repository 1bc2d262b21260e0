"""Phrases, divergence and token counts against brute force and on edge cases."""

from __future__ import annotations

import collections
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from lamina.llm import collocations, divergence, token_counts

CLASHING = "doc_id long, text string, lang string, source string, n string, key string, rank string, term string, value string"


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(token_counts.default_tokenizer())


def mixed_texts(n: int) -> list[str]:
    rng = random.Random(5)
    parts = ["a", "aa", "aaa", "the", " ", "  ", "\n", "é", "ß", "1", "23", "!", "...", "'s", "'ll", "<|endoftext|>", "<|endoftext", "　", "\U0001f600", "՘", "࢏", "中文", "x" * 50, "\t", "\r\n", "\x1c", "\x00", "ing", "tion", " ", "﻿"]
    return ["".join(rng.choices(parts, k=rng.randint(0, 40))) for _ in range(n)]


def test_token_counts_against_the_library(spark, library):
    texts = [None, "", "x" * 5000, "=" * 3001, "<|endoftext|>" * 3, " ".join(["word"] * 250_000)] + mixed_texts(1500)
    rows = [(i, t, "l", "s", "n", "k", "r", "t", "v") for i, t in enumerate(texts)] + [(None, "a b", "l", "s", "n", "k", "r", "t", "v")] * 2
    found = token_counts.count_tokens(spark.createDataFrame(rows, CLASHING).repartition(3))
    assert found.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    wanted = [len(e.ids) for e in library.encode_batch([r[1] or "" for r in rows], add_special_tokens=False)]
    key = lambda r: str(tuple(r))
    assert sorted(map(tuple, found.collect()), key=key) == sorted(((r[0], len((r[1] or "").encode()), n, n > 1024) for r, n in zip(rows, wanted)), key=key)
    assert token_counts.count_tokens(spark.createDataFrame([], CLASHING)).collect() == []


def test_token_counts_in_short_runs_and_small_caches(library, monkeypatch):
    monkeypatch.setattr(token_counts, "RUN_PRETOKENS", 7)
    monkeypatch.setattr(token_counts, "CACHE_WORDS", 20)
    monkeypatch.setattr(token_counts, "CACHE_BYTES", 3)
    texts = mixed_texts(400)
    assert token_counts.TokenCounter(token_counts.default_tokenizer()).counts(texts) == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


def test_merges_out_of_order_are_refused():
    letters = {"a": 0, "b": 1, "ab": 2, "aba": 3}
    with pytest.raises(ValueError):
        token_counts.PairMerger(letters, [["ab", "a"], ["a", "b"]])
    assert token_counts.PairMerger(letters, [["a", "b"], ["ab", "a"]]).counts([b"ababa", b"b"]).tolist() == [2, 1]
    assert token_counts.PairMerger(letters, []).counts([b"ab", b"a"]).tolist() == [2, 1]


@pytest.fixture(scope="module")
def corpus(spark):
    """Languages with many, few and no kept terms; nulls, empty and long texts, repeats and clashing names."""
    rng = random.Random(8)
    words = [w + s for w in ("the", "of", "Élan", "x", "straße", "Ω", "über") for s in ("", "a", "B", "é")]
    pieces = [*words, "the of", "the of x", ",", ".", "\t", "\n", "\x0b", "\x1c", "1", "a1b", "don't", "  ", "élan, the"]
    prose = lambda n: " ".join(rng.choice(pieces) for _ in range(n))
    rows = [(i, prose(rng.randint(0, 60)), rng.choice(["en", "de", None]), f"s{rng.randint(0, 6)}" if i % 9 else None) for i in range(150)]
    rows += [(200, None, "en", "empty"), (201, "", "zz", "a"), (202, "alone twice", "zz", "b"), (203, "x of " * 3000, "en", "s1"), (None, prose(40), "en", "s1"), (5, "same row", "", ""), (5, "same row", "", ""), (5, "same row", None, "c")]
    return spark.createDataFrame([(i, t, lang, source, "n", "k", "r", "t", "v") for i, t, lang, source in rows], CLASHING).repartition(4).cache()


def brute_divergence(rows):
    docs = [(r.lang or "", r.source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (r.text or "").encode().lower().decode())) for r in rows]
    found = set()
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        seen = collections.Counter(t for _, _, w in own for t in set(w))
        kept = {t for t, n in seen.items() if n >= 3}
        counts = {s: collections.Counter() for _, s, _ in own}
        for _, s, w in own:
            counts[s].update(t for t in w if t in kept)
        whole = sum(counts.values(), collections.Counter())
        share = lambda c, t: 1 + 1_000_000_000 * (c[t] + 1) // (sum(c.values()) + len(kept))
        f = lambda p, q: (p - q) ** 2 // q
        for s, c in counts.items():
            pairs = [(o, sum(f(share(c, t), share(d, t)) for t in kept)) for o, d in counts.items() if o != s]
            terms = [(t, f(share(c, t), share(whole, t))) for t in kept if c[t] and share(c, t) > share(whole, t)]
            for part, items, most in (("pair", pairs, len(pairs)), ("term", terms, 200)):
                ordered = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most]
                found |= {(lang, s, part, item, value, i + 1) for i, (item, value) in enumerate(ordered)}
    return found


@pytest.mark.parametrize("options", [{}, {"block_bytes": 500, "segment_terms": 5, "block_sources": 2}])
def test_divergence_against_brute_force(spark, corpus, options):
    found = divergence.audit(corpus, **options)
    rows = [tuple(r) for r in found.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == brute_divergence(corpus.collect())
    assert [r for r in rows if r[0] == "zz"] == [("zz", "a", "pair", "b", 0, 1), ("zz", "b", "pair", "a", 0, 1)]
    assert divergence.audit(spark.createDataFrame([], CLASHING)).collect() == []


def test_segment_trees_share_nodes_and_stay_exact():
    counts = np.zeros((3, 64), np.int64)
    counts[:, 5] = [1, 1, 2]
    trees = divergence.SegmentTrees(counts)
    assert trees.roots[0] == trees.roots[1] != trees.roots[2]
    assert [len(left) for left, _ in trees.children] == [3, 3, 3, 3, 3, 2]  # no term but the fifth tells nodes apart
    total = divergence.MOST - 1
    for count in (0, 7, total // 3, total - 1):
        exact = 1 + 10**9 * (count + 1) // total
        assert divergence.shares(np.array([count]), np.array([total])).tolist() == [exact]


def brute_collocations(rows, least, top=2000):
    counts = collections.defaultdict(collections.Counter)
    totals = collections.Counter()
    for r in rows:
        for piece in re.split("[.,;:!?\\x0A-\\x0D]", (r.text or "").encode().lower().decode()):
            words = re.findall("[^\\x20\\x09]+", piece)
            lang = "und" if r.lang is None else r.lang
            totals[lang] += len(words)
            for n in range(1, 5):
                counts[lang].update(" ".join(words[i : i + n]) for i in range(len(words) - n + 1))
    out = set()
    for lang, f in counts.items():
        candidates = {p: a for p, a in f.items() if a >= least and " " in p}
        dropped, scored = set(), []
        for p, a in candidates.items():
            w = p.split(" ")
            for n in range(2, len(w)):
                dropped |= {q for i in range(len(w) - n + 1) if 100 * a >= 80 * f[q := " ".join(w[i : i + n])]}
            score, _, l, r = min((2_000_000 * a // (f[x] + f[y]), k, f[x], f[y]) for k in range(1, len(w)) for x, y in [(" ".join(w[:k]), " ".join(w[k:]))])
            scored.append((-score, -a, p.encode(), l, r))
        kept = sorted(s for s in scored if s[2].decode() not in dropped)[:top]
        out |= {(lang, i + 1, p.decode(), -a, l, r, totals[lang], -score) for i, (score, a, p, l, r) in enumerate(kept)}
    return out


@pytest.mark.parametrize("options", [{}, {"least": 3, "block_bytes": 300}, {"least": 2, "top": 7}])
def test_collocations_against_brute_force(spark, corpus, options):
    rows = [tuple(r) for r in collocations.collocations(corpus, **options).collect()]
    assert len(rows) == len(set(rows)) and set(rows) == brute_collocations(corpus.collect(), options.get("least", 30), options.get("top", 2000))
    assert rows and any(" " in r[2] and r[0] == "und" for r in rows)


def test_collocations_of_nothing(spark):
    assert collocations.collocations(spark.createDataFrame([], CLASHING)).collect() == []
    assert collocations.collocations(spark.createDataFrame([(1, None, None, None, "n", "k", "r", "t", "v")], CLASHING)).collect() == []


@pytest.mark.parametrize("waiting", [1, 50, 10_000])
def test_misra_gries_loses_nothing_frequent(monkeypatch, waiting):
    monkeypatch.setattr(collocations, "WAITING", waiting)
    rng, least = np.random.default_rng(3), 30
    stream = np.minimum(rng.zipf(1.3, 60_000), 1 << 40).astype(np.uint64)
    capacity = len(stream) // least + 1
    whole, halves = collocations.MisraGries(capacity), [collocations.MisraGries(capacity) for _ in range(2)]
    for i, part in enumerate(np.array_split(stream, 40)):
        keys, counts = np.unique(part, return_counts=True)
        whole.add(keys, counts)
        halves[i % 2].add(keys, counts)
    halves[0].merge(halves[1])
    keys, counts = np.unique(stream, return_counts=True)
    true = dict(zip(keys.tolist(), counts.tolist()))
    for summary in (whole, halves[0]):
        left = set(summary.survivors(least).tolist())
        assert {k for k, n in true.items() if n >= least} <= left
        assert summary.error < least and len(summary.keys) <= capacity
        assert all(n <= true[k] <= n + summary.error for k, n in zip(summary.keys.tolist(), summary.counts.tolist()))


class Value:
    def __init__(self, value):
        self.value = value


def test_summaries_by_bucket_and_bitmaps():
    rng = np.random.default_rng(4)
    keys = np.sort(rng.integers(0, 1 << 63, 4000, dtype=np.uint64) << np.uint64(1))
    counts = rng.integers(1, 60, len(keys))
    rows = [(int(k >> np.uint64(61)), k, n) for k, n in zip(keys, counts)]
    columns = lambda part: pa.RecordBatch.from_arrays([pa.array([b for b, _, _ in part], pa.int32()), pa.array([k.tobytes() for _, k, _ in part], pa.binary()), pa.array([np.int32(n).tobytes() for _, _, n in part], pa.binary())], ["bucket", "keys", "counts"])
    masses = {b: int(counts[keys >> np.uint64(61) == b].sum()) for b in range(8)}
    out = list(collocations._summarise(Value(masses), 30)(iter([columns(rows[:1500]), columns(rows[1500:1501]), columns(rows[1501:])])))
    left = np.concatenate([np.frombuffer(k, np.uint64) for b in out for k in b.column(2).to_pylist()])
    assert sorted(left.tolist()) == sorted(keys[counts >= 30].tolist())
    parts = {b: collocations.Bitmap.part_of(left[left >> np.uint64(61) == b], 1 << 13) for b in range(8)}
    bitmap = collocations.Bitmap(3, parts, 1 << 16)
    assert bitmap.has(left).all() and bitmap.has(keys[counts < 30]).mean() < 0.2


def test_phrases_with_one_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(collocations.xxhash, "xxh3_64_intdigest", lambda *a, **k: 7)
    power, every = 8, (b"\xff" * 32)
    bitmap = Value(collocations.Bitmap(power, {b: every for b in range(256)}, 1 << 16))
    batch = pa.RecordBatch.from_arrays([pa.array(["en", "en"]), pa.array(["a b, a b c", "b a b"])], ["lang", "text"])
    found = collections.Counter()
    for out in collocations._count_phrases(1 << 20, bitmap, bitmap)(iter([batch])):
        for row in out.to_pylist():
            found[row["phrase"]] += row["f"]
    assert found == {"": 8, "a": 3, "b": 4, "c": 1, "a b": 3, "b c": 1, "b a": 1, "a b c": 1, "b a b": 1}
