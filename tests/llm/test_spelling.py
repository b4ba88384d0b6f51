"""Spelling variants against brute force."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from bitquilt.llm import fm_index, spelling

SCHEMA = "doc_id bigint, text string, lang string"


def is_near(a: str, b: str) -> bool:
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute_force(rows: list[tuple], shortest: int = 6, least: int = 5, ratio: int = 5, odds: int = 199) -> list[tuple]:
    n = Counter()
    for doc_id, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{doc_id}:{run}".encode())
            if doc_id is not None and h % odds == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            n[run] += 1
    n = {w: k for w, k in n.items() if len(w) >= shortest and k >= least}
    near = {w: [v for v in n if is_near(w, v)] for w in n}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= ratio * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, n[w], len(near[w]), form[w], n.get(form[w]), root))
    return sorted(out)


def made_rows(seed: int, n: int, letters: str = "abcéÉ×ÿ") -> list[tuple]:
    r = random.Random(seed)
    bases = ["".join(r.choice(letters) for _ in range(r.randint(5, 9))) for _ in range(25)] + ["aaaaaa", "aaaaaaa", "Aaaaaaaa"]
    pool = []
    for b in bases:
        pool += [b] * r.choice([1, 5, 40, 200])
        for _ in range(4):
            i = r.randrange(len(b))
            pool += [r.choice([b[:i] + b[i + 1:], b[:i] + r.choice(letters) + b[i:], b[:i] + r.choice(letters) + b[i + 1:]])] * r.choice([1, 3, 8])
    return [(i if r.random() > 0.1 else None, r.choice([" ", "-", "1", "'"]).join(r.choice(pool) for _ in range(r.randint(0, 60))) if r.random() > 0.05 else None, "x") for i in range(n)]


@pytest.mark.parametrize("shard", [spelling.SHARD, 6])
def test_equals_brute_force(spark, shard):
    rows = made_rows(shard, 150)
    docs = spark.createDataFrame(rows + rows[:2], SCHEMA).withColumns({"word": F.lit("x"), "n": F.lit(1), "a.b": F.lit(2)})
    got = spelling.spelling_variants(spelling.altered_runs(docs, odds=9), shortest=5, least=2, ratio=2, shard=shard).select("word", "n", "n_near", "form", "form_n", "root")
    want = brute_force(rows + rows[:2], 5, 2, 2, 9)
    assert sorted(map(tuple, got.collect())) == want and sum(x[3] is not None for x in want) > 5


def test_odd_tables(spark):
    for rows in ([], [(1, None, None), (2, "", ""), (3, "123", "en")], [(1, "short " * 9, None)]):
        docs = spark.createDataFrame(rows, SCHEMA)
        assert spelling.spelling_variants(spelling.altered_runs(docs)).collect() == []
    long = spark.createDataFrame([(i, "x" * 3000 + " " + "x" * 2999, None) for i in range(6)], SCHEMA)
    assert {(len(r["word"]), r["n_near"]) for r in spelling.spelling_variants(spelling.altered_runs(long)).collect()} == {(3000, 1), (2999, 1)}


def test_roots_follow_long_chains(spark):
    chain = spark.createDataFrame([(f"w{i:02}", f"w{i + 1:02}") for i in range(21)] + [("a", "w20")], "word string, form string")
    assert {tuple(r) for r in spelling.roots_of(chain).collect()} == {(f"w{i:02}", "w21") for i in range(21)} | {("a", "w21")}


@pytest.mark.parametrize("letters,n", [("ab", 60), ("abcdefgh", 400), ("aé日\U0001F600b", 200)])
def test_search_schemes(letters, n):
    r = random.Random(n)
    words = sorted({"".join(r.choice(letters) for _ in range(r.randint(2, 7))) for _ in range(n)})
    index = fm_index.BiIndex(words)
    for length in range(2, 8):
        asked = [w for w in words if len(w) == length] + ["".join(r.choice(letters + "z") for _ in range(length)) for _ in range(20)]
        codes = index.codes(np.frombuffer("".join(asked).encode("utf-32-le"), np.uint32).reshape(len(asked), length))
        half = length // 2
        for left in (True, False):
            who, word = fm_index.one_error(index, codes, half, left)
            got = {(asked[a], words[b]) for a, b in zip(who, word, strict=True)}
            same = (lambda a, b: b.startswith(a[:half])) if left else (lambda a, b: b.endswith(a[half:]))
            near = {(a, b) for a in set(asked) for b in words if is_near(a, b)}
            assert got <= near and got >= {(a, b) for a, b in near if same(a, b)}
