"""Phrase collocations against a brute-force count."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from bitquilt.llm import collocations
from bitquilt.llm.double_array import DoubleArray

SCHEMA = "doc_id bigint, text string, lang string"


def brute_force(rows: list[tuple], most: int, least: int) -> list[tuple]:
    f, n = Counter(), Counter()
    for _, text, lang in rows:
        lang = lang or "und"
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i:i + k])) for k in range(1, 6) for i in range(len(w) - k + 1))
    often = {x: a for x, a in f.items() if a >= least and len(x[1]) > 1}
    out = []
    for (lang, w), a in often.items():
        longer = [b for (other, v), b in often.items() if other == lang and len(v) > len(w) and any(v[i:i + len(w)] == w for i in range(len(v)))]
        if any(100 * b >= 100 * a for b in longer):
            continue
        cuts = [(1000 * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        out.append((lang, " ".join(w), a, f[lang, w[:k]], f[lang, w[k:]], n[lang], score))
    ranked = []
    for lang in {x[0] for x in out}:
        own = sorted((x for x in out if x[0] == lang), key=lambda x: (-x[6], -x[2], x[1].encode()))
        ranked += [(lang, i + 1, *x[1:]) for i, x in enumerate(own[:most])]
    return sorted(ranked)


def made_rows(seed: int, n: int) -> list[tuple]:
    r = random.Random(seed)
    words = ["a", "A", "Of", "the", "new", "york", "é", "É", "ñandú", "x\x00y", "日本", " ", "w" * 300, "to-day", "it's"]
    glue = [" "] * 12 + ["  ", "\t", ". ", ",", "\n", "\r\n", "!", "\x0b", "\x1c"]
    rows = []
    for i in range(n):
        text = "".join(r.choice(words[:6] if r.random() < 0.7 else words) + r.choice(glue) for _ in range(r.randint(0, 60)))
        rows.append((i, text if r.random() > 0.05 else None, r.choice(["en", "fr", None])))
    return rows + rows[:3] + [(None, "the new york the new york the new york", "en"), (None, "", ""), (None, "...", "fr")]


@pytest.mark.parametrize("block,least,most", [(1 << 18, 3, 2000), (5, 4, 2000), (1 << 18, 9, 7)])
def test_equals_brute_force(spark, block, least, most):
    rows = made_rows(block + least, 60)
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({"w": F.lit(1), "a": F.lit(2), "n": F.lit(3), "a.b": F.lit(4)})
    got = sorted(map(tuple, collocations.collocations(docs, most, least, block=block).collect()))
    assert got == brute_force(rows, most, least) and got


def test_empty_and_rare(spark):
    docs = spark.createDataFrame(made_rows(1, 20), SCHEMA)
    for given, least in ((docs.limit(0), 2), (docs, 10_000), (spark.createDataFrame([(1, "a. a. a. b", None)], SCHEMA), 2)):
        assert collocations.collocations(given, least=least).collect() == []


def test_scores_beyond_64_bits(spark, monkeypatch):
    big = 3_000_000_000_000
    words = spark.createDataFrame([(0, "en", "x", big, 5 * big), (1, "en", "y", big + 1, 5 * big)], "id long, lang string, word string, f long, n long")
    phrases = spark.createDataFrame([([0, 1], big - 1)], "w array<int>, a long")
    monkeypatch.setattr(collocations, "frequent_phrases", lambda *_: (words, [phrases]))
    row = collocations.collocations(words).collect()[0]
    assert row["score"] == 1000 * (big - 1) * 5 * big // (big * (big + 1)) and row["phrase"] == "x y"


@pytest.mark.parametrize("size,k,n", [(200, 1, 150), (300, 3, 4000), (70_000, 2, 5000), (1 << 24, 4, 2000), (40, 5, 1), (7, 2, 49)])
def test_double_array(size, k, n):
    r = np.random.default_rng(n)
    phrases = np.unique(r.integers(0, size, (n, k)) // r.choice([1, 1, max(size // 9, 1)], (n, 1)), axis=0)
    trie = DoubleArray(r.permutation(phrases), size)
    known = {tuple(p): i for i, p in enumerate(trie.phrases.tolist())}
    ids = np.concatenate([phrases[r.integers(0, len(phrases), 300)].reshape(-1), r.integers(-1, min(size, 50), 500)])
    at, found = trie.walk(ids)
    want = {i: known[tuple(ids[i:i + k].tolist())] for i in range(len(ids) - k + 1) if tuple(ids[i:i + k].tolist()) in known}
    assert dict(zip(at.tolist(), found.tolist(), strict=True)) == want
    assert len(trie.walk(ids[:k - 1])[0]) == 0 and (at[1:] > at[:-1]).all()


def test_wide_nodes():
    phrases = np.array([(a, b) for a in range(0, 256, 3) for b in range(0, 200, 1 + a % 7)])
    trie = DoubleArray(phrases, 256)
    at, found = trie.walk(phrases.reshape(-1))
    assert (found[at % 2 == 0] == np.arange(len(phrases))).all()
