"""op5's operator against all pairs in plain Python, and how often a block of vectors travels."""

import random

import pytest

from bitquilt.llm import topk


def brute(rows, queries, k):
    out = []
    for q, v in rows.items():
        if q in queries:
            scores = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in rows.items() if i != q and len(w) == len(v))
            out += [(q, n + 1, i, -score) for n, (score, i) in enumerate(scores[:k])]
    return sorted(out)


def vectors_of(kind):
    r = random.Random(kind)
    rows = {i: [r.randint(-300, 300) for _ in range(12)] for i in range(300)}
    if kind == "lengths and ties":
        rows = {i: [x * (1 + i % 7) ** 2 // 9 for x in rows[i % 90]] for i in rows}
    elif kind == "few coordinates":
        rows = {i: [x if j in (i % 12, i % 5) else x // 100 for j, x in enumerate(v)] for i, v in rows.items()}
    elif kind == "dimensions":
        rows = {i: [x // 50 for x in v[: i % 6]] for i, v in rows.items()}
    elif kind == "beyond 32 bits":
        rows = {i: [x * 4001 + j for j, x in enumerate(v)] for i, v in rows.items()}
    return rows


@pytest.mark.parametrize("kind", ["lengths and ties", "few coordinates", "dimensions", "beyond 32 bits"])
def test_topk_is_that_of_all_pairs(spark, monkeypatch, kind):
    for name, n in (("BLOCK_ROWS", 32), ("QUERY_ROWS", 4), ("VECTOR_BLOCKS", 2), ("QUERY_BLOCKS", 2)):
        monkeypatch.setattr(topk, name, n, raising=False)
    rows = vectors_of(kind)
    frame = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows.items()], "vec_id long, v array<double>")
    found = topk.exact_topk(frame.where("vec_id % 3 = 0"), frame, 4)
    assert sorted(tuple(x) for x in found.collect()) == brute(rows, {i for i in rows if i % 3 == 0}, 4)


def test_a_block_travels_once_per_group(spark, monkeypatch):
    for name, n in (("BLOCK_ROWS", 32), ("QUERY_ROWS", 4), ("VECTOR_BLOCKS", 2), ("QUERY_BLOCKS", 5)):
        monkeypatch.setattr(topk, name, n)
    seen, cells = [], topk.cells
    monkeypatch.setattr(topk, "cells", lambda meetings, asked, stored: seen.append((meetings, asked, stored, cells(meetings, asked, stored))) or seen[-1][-1])
    frame = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in vectors_of("few coordinates").items()], "vec_id long, v array<double>")
    topk.exact_topk(frame.where("vec_id % 3 = 0"), frame, 4)
    meetings, asked, stored, rows = seen[-1]
    assert asked.groups >= 4 and stored.groups >= 4
    assert rows.where("NOT asks").count() <= stored.n * asked.groups < meetings.count()
    assert rows.where("asks").count() <= asked.n * stored.groups < meetings.count()
