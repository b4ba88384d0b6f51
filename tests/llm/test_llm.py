"""Operators for training data against SQL, plain Python and exact round trips."""

import hashlib
import os
import random
import re
import textwrap
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from check import compare
from pyspark.sql import functions as F

from bitquilt.llm import chat_tree, decontaminate, jaccard_join, language_id, license_scan, mixing, queries, suffix_dedup, token_counts, topk, url_filter

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score string"
ODD = [
    (1, None, None, None, None, "x"), (2, "", "en", "a", 0, None), (3, "   ", None, "a", 3, None), (4, "one", "en", None, 3, None),
    (5, "w" * 3000, "fr", "b", 3000, None), (None, "no id here at all", "en", "b", 17, None), (6, "same words again and again", "en", "b", 26, None),
    (7, "same words again and again", "en", "b", 26, None), (7, "same words again and again", "en", "b", 26, None),
]


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, sf_dir, duck, name):
    assert compare(queries.QUERIES[name](spark, sf_dir), duck, queries.SQL[name]) == ""


def texts(seed: int, n: int) -> list[tuple]:
    r = random.Random(seed)
    words = ["".join(r.choice("abcdeéX") for _ in range(r.randint(1, 7))) for _ in range(80)]
    pool, rows = [], []
    for _ in range(n):
        w = list(r.choice(pool)) if pool and r.random() < 0.6 else [r.choice(words) for _ in range(r.choice([0, 1, 4, 5, 6, 30, 90]))]
        for _ in range(r.randint(0, 3)):
            k = r.randint(0, len(w))
            w[k:k + r.randint(0, 1)] = [r.choice(words)] * r.randint(0, 1)
        pool.append(w)
        rows.append((r.randint(0, 10**6), " ".join(w) if r.random() > 0.03 else None))
    return rows + rows[:1]


def test_suffix_dedup_equals_brute_force(spark):
    rows, length = texts(1, 120) + [(None, "z" * 80), (1, "z" * 70), (10**7, "z" * 60)], suffix_dedup.LENGTH
    first: dict[bytes, int] = {}
    data = [(d, (t or "").encode()) for d, t in rows]
    for d, b in data:
        for p in range(len(b) - length + 1):
            if d is not None:
                first[b[p:p + length]] = min(d, first.get(b[p:p + length], d))
    want = []
    for d, b in data:
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if d is not None and first[b[p:p + length]] < d:
                gone[p:p + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        want.append((d, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_surroundings_are_told_apart_by_64_bits():
    data = np.random.default_rng(3).integers(97, 123, 4000).astype(np.uint8)
    e = suffix_dedup.Entries(data, np.array([0, 2000, 4000]), 4, suffix_dedup.LENGTH, suffix_dedup.GRAM)
    assert (e.rest >> np.uint64(56)).any()
    key, ids = np.array([77], np.uint64), [np.array([i], np.int64).tobytes() for i in (1, 2, 3)]
    rest = [np.array([x], "<u8").tobytes() for x in (5, 5 + (1 << 45), 5)]
    rows = [suffix_dedup._packed(i, 0, ids[i], np.array([[0], [1]], np.int32).tobytes(), suffix_dedup.narrow(key), rest[i]) for i in range(3)]
    found = suffix_dedup.decide(pa.Table.from_batches(rows))["rest"].to_pylist()
    assert [x[0] for x in found] == [suffix_dedup.SOURCE, suffix_dedup.OPEN, suffix_dedup.COVERED]


@pytest.mark.parametrize(("rounds", "bucket"), [(4, 1024), (0, 3)])
def test_jaccard_join_equals_brute_force(spark, monkeypatch, rounds, bucket):
    # without rounds all pairs are compared at once, in many buckets
    monkeypatch.setattr(jaccard_join, "HUB_ROUNDS", rounds)
    monkeypatch.setattr(jaccard_join, "BUCKET", bucket)
    rows = texts(2, 250)
    sets = []
    for _, t in rows:
        w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in re.findall(r"[^\x20\x09-\x0D]+", t or "")]
        sets.append({tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    least = {d: d for d, _ in rows}
    changed = True
    while changed:
        changed = False
        for i in range(len(rows)):
            for j in range(i):
                both = len(sets[i] & sets[j])
                a, b = least[rows[i][0]], least[rows[j][0]]
                if a != b and sets[i] and 100 * both >= 80 * len(sets[i] | sets[j]):
                    least[rows[i][0]] = least[rows[j][0]] = min(a, b)
                    changed = True
    got = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got)) == sorted((d, len(s), least[d]) for (d, _), s in zip(rows, sets, strict=True))


def test_parity_sketches_never_exceed_the_difference(monkeypatch):
    monkeypatch.setattr(jaccard_join, "SKETCH_ROWS", 7)
    r = random.Random(5)
    pool = [r.getrandbits(63) for _ in range(900)]
    sets = [sorted(set(r.sample(pool, r.choice([0, 1, 40, 300, 800])))) for _ in range(30)]
    row = np.repeat(np.arange(30), [len(x) for x in sets])
    got = jaccard_join.parity_sketches(row, np.array([t for x in sets for t in x], np.int64), 30).view(np.uint64)
    for i in range(30):
        for j in range(30):
            apart = sum(int(a ^ b).bit_count() for a, b in zip(got[i].tolist(), got[j].tolist(), strict=True))
            assert apart <= len(set(sets[i]) ^ set(sets[j]))
            assert i != j or apart == 0


def test_token_counts_of_every_prefix():
    from tokenizers import Tokenizer

    model, library, r = token_counts.PrefixCounts(queries.vocabulary()), Tokenizer.from_file(queries.vocabulary()), random.Random(3)
    bits = ["the", "  ", "\n\n", " ", "\t", "'re", "'s", "'ll", "don't", "!!", "\"'", "12", "é", "日本", "😀", " thing", "<|endoftext|>", "<|end", "A'B", "\x1c", " "]
    for _ in range(150):
        text = "".join(r.choice(bits) for _ in range(r.randint(0, 10)))
        want = [len(library.encode(text[:i], add_special_tokens=False).ids) for i in range(len(text) + 1)]
        table = next(model.tables([text]))
        assert [table.at(i) for i in range(len(text) + 1)] == want
        assert all(table.within(b) == max(i for i, n in enumerate(want) if n <= b) for b in (0, 1, 4))


def test_token_counts_of_long_words():
    from tokenizers import Tokenizer

    model, library, r = token_counts.PrefixCounts(queries.vocabulary()), Tokenizer.from_file(queries.vocabulary()), random.Random(5)
    words = ["".join(r.choice("acgt") for _ in range(200)), " " + "the" * 60, "é日本😀" * 40, " " * 130, "!" * 70 + "<|" * 20, "\n \t" * 40, "9" * 99, "'" * 80]
    for _ in range(25):
        text = "".join(r.choice([*words, "a", " ", "'re", "<|endoftext|>", "."]) for _ in range(r.randint(1, 5)))
        want = [len(library.encode(text[:i], add_special_tokens=False).ids) for i in range(len(text) + 1)]
        table = next(model.tables([text]))
        assert [table.at(i) for i in range(len(text) + 1)] == want
        for budget in (0, 1, 4, 20, 45, 90):
            assert next(model.tables([text])).within(budget) == max(i for i, n in enumerate(want) if n <= budget)


def test_a_word_of_any_length_takes_time_in_proportion():
    r = random.Random(7)
    text = "".join(r.choice("acgt") for _ in range(200_000))
    model, began = token_counts.PrefixCounts(queries.vocabulary()), time.monotonic()
    table = next(model.tables([text]))
    cut = table.within(1024)
    assert table.at(cut) <= 1024 < table.at(cut + 1) <= table.total
    assert [p for p, _ in model.segments("<|endoftext|>" * 20_000)] == ["<|endoftext|>"] * 20_000
    assert not any(len(w) > token_counts.KEPT_WORD for w in model.counts)
    # with a new encoding for each shorter prefix it were hours
    assert time.monotonic() - began < 60


def test_token_counts_query_equals_the_library(spark, sf_dir):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(queries.vocabulary())
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    found = queries.QUERIES["op10_token_prefixes"](spark, sf_dir).collect()
    assert len(found) == len(texts)
    for r in found:
        n = len(library.encode(texts[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id].encode()), n, n > 1024)


def test_language_id_on_held_out_documents(spark, sf_dir):
    found = queries.QUERIES["op9_language_id"](spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out")
    assert found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.95


def test_license_scan(spark):
    rows = [(1, "Words.\nReleased under the MIT License.\nMore."), (2, "Licensed under the Apache License, Version 3.0."), (3, "nothing"), (4, None)]
    got = {r["doc_id"]: (r["license"], r["confirmed"]) for r in license_scan.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == ("MIT", True) and not got[2][1] and set(got) == {1, 2}


def notice(r: random.Random, name: str) -> str:
    """A template as it may be found: up to a fifth of a long one's words without a digit left out or foreign."""
    words = license_scan.TEMPLATES[name].split(" ")
    for _ in range(r.randint(0, len(words) // 12) if len(words) > 12 else 0):
        i = r.randrange(1, len(words))
        words[i:i + (not re.search(r"\d", words[i]) and r.randint(0, 1))] = ["foreign"]
    return " ".join(words)


def test_license_scan_finds_every_notice_of_a_block():
    scanner, r = license_scan.Scanner(license_scan.TEMPLATES), random.Random(5)
    adjacent = scanner.scan("Released under the MIT License.\nAll rights reserved.")
    assert [(x["license"], x["start"], x["end"]) for x in adjacent] == [("MIT", 0, 30), ("All-rights-reserved", 32, 51)]
    for _ in range(60):
        names = [r.choice(sorted(license_scan.TEMPLATES)) for _ in range(r.randint(1, 6))]
        parts = [notice(r, n) for n in names]
        text = r.choice(["\n", " "]).join(parts)
        found = [x for x in scanner.scan(text) if x["confirmed"]]
        assert [x["license"] for x in found] == names, text
        for x, part in zip(found, parts, strict=True):
            assert text[x["start"]:x["end"]] in part


def test_license_scan_finds_wrapped_and_straddling_notices(spark):
    scanner, r = license_scan.Scanner(license_scan.TEMPLATES), random.Random(7)
    prose = "some words of prose that say nothing about it ".split()
    rows, want = [], []
    for name, text in sorted(license_scan.TEMPLATES.items()):
        for k in range(12):
            before, after = (" ".join(r.choice(prose) for _ in range(r.choice([0, 5, 90, 300]))) for _ in range(2))
            sep, lead = r.choice([" ", "\n", "\n\n"]), r.choice(["", " * ", "# ", "    "])
            body = text if k % 3 == 2 else ("\n" + r.choice(["", "\n"]) + lead).join(textwrap.wrap(text, r.choice([20, 40, 76]), break_long_words=False, break_on_hyphens=False))
            # a cue some way before a notice in the same long line
            near = "see the licence " + " ".join(r.choice(prose) for _ in range(k * 14)) + sep if k % 2 else ""
            rows.append((len(rows), before + sep + near + body + sep + after))
            want.append((name, rows[-1][1].find(body)))
    got = license_scan.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).where("confirmed").collect()
    assert sorted((x["doc_id"], x["license"], x["start"]) for x in got) == [(i, *w) for i, w in enumerate(want)]
    for i, text in rows[:40]:  # brute force: the whole text as one block
        words = [m.group() for m in license_scan.WORDS.finditer(text.lower())]
        assert [n for n, _, _ in scanner.notices(words)] == [want[i][0]]


def test_license_stretches_equal_brute_force():
    scanner = license_scan.Scanner({"long": "a b c d e f g h i j k l m", "short": "b a c", "number": "a b c d e f g h i j k l 2.0"})
    r = random.Random(6)

    def least(want: list[str], have: list[str]) -> int:
        row = [0] * (len(have) + 1)
        for w in want:
            new = [0]
            for j, h in enumerate(have):
                new.append(row[j] + 1 if h == w else max(row[j + 1], new[-1]))
            row = new
        return len(want) + len(have) - 2 * row[-1]

    for _ in range(150):
        base = r.choice(["a b c d e f g h i j k l m", "b a c", "a b c d e f g h i j k l 2.0", ""]).split()
        words = [r.choice("abxy") for _ in range(r.randint(0, 4))] + [w for w in base if r.random() > 0.08] + [r.choice("abxy") for _ in range(r.randint(0, 4))]
        for n in scanner.names:
            want = scanner.words[n]
            fits = [(i, j) for i in range(len(words)) for j in range(i + 1, len(words) + 1)
                    if ("2.0" in words[i:j]) == ("2.0" in want) and least(want, words[i:j]) <= scanner.allowed(n)]
            # a short notice may lie in words that a longer one has taken
            one = license_scan.Scanner({n: " ".join(want)})
            assert bool(fits) == bool(one.notices(words)), (n, words)


@pytest.mark.parametrize("coalesce", ["true", "false"])
def test_prefix_tree_shares_turns(spark, coalesce):
    # without coalescing, every range of the sorted conversations is a partition of its own
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesce)
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"turn {t if t < 2 else c * 10 + t}") for c in range(20) for t in range(4)]
    sequence, members = chat_tree.prefix_tree(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), queries.vocabulary())
    nodes = sorted(sequence.collect(), key=lambda r: r["start"])
    assert len(nodes) == 2 + 20 * 2 and members.count() == 20
    end = 0
    for n in nodes:
        assert n["start"] == end and n["position"] == sum(s["end"] - s["start"] for s in n["ancestors"]) and all(s["end"] <= end for s in n["ancestors"])
        end += len(n["tokens"])
    digests = chat_tree.conversation_digests(sequence, members, queries.vocabulary()).collect()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for d in digests:
        said = [(r, x) for c, _, r, x in rows if c == d["conv_id"]]
        assert d["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in said).encode()).hexdigest()
        assert d["loss_sha256"] == hashlib.sha256("".join(x for r, x in said if r == "assistant").encode()).hexdigest()
    assert len(digests) == 20


def test_long_conversation_has_few_intervals(spark):
    rows = [(c, t, "user", f"{t}" if t < 290 + c else f"{c} {t}") for c in range(3) for t in range(300)] + [(9, None, None, None), (9, 0, "user", "0")]
    sequence, members = chat_tree.prefix_tree(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), queries.vocabulary())
    nodes = sequence.collect()
    assert len(nodes) == len({tuple(x[2:] for x in rows if x[0] == c and (x[1] or 0) <= t) for c in (0, 1, 2) for t in range(300)}) + 2
    assert max(len(n["ancestors"]) for n in nodes) <= 3 and sum(n["turns"] for n in members.withColumnRenamed("n_turns", "turns").collect()) == 902
    assert not chat_tree.prefix_tree(spark.createDataFrame(rows[:1], "conv_id long, turn long, role string, text string").limit(0), queries.vocabulary())[1].count()


def test_odd_rows_and_empty_tables(spark):
    odd = spark.createDataFrame(ODD, SCHEMA)
    for docs, n in ((odd, len(ODD)), (odd.limit(0), 0)):
        assert mixing.mix_plan(docs).count() == n
        assert token_counts.token_prefixes(docs, queries.vocabulary(), 4).count() == n
        assert suffix_dedup.remove_repeats(docs).count() == n
        assert jaccard_join.jaccard_components(docs).count() == n
        assert license_scan.scan_licenses(docs).count() == 0
        profiles = language_id.learn_profiles(docs)
        assert {r["lang_pred"] for r in language_id.predict_languages(docs, profiles).where("doc_id IN (1, 2, 3)").collect()} <= {"und"}
        items = spark.createDataFrame([(1, "same words again and again"), (2, None), (3, "")], "item_id long, text string")
        assert {r["doc_id"] for r in decontaminate.contaminated(docs, items).collect()} == ({6, 7} if n else set())
    vectors = spark.createDataFrame([(0, [1.0, None]), (1, None), (2, [float("nan"), 1.0]), (50, [1.0, 2.0]), (51, [1.0, 2.0]), (52, [1.0, 2.0])], "vec_id long, embedding array<float>")
    fit = topk.integer_vectors(vectors)
    assert [tuple(r)[:3] for r in topk.exact_topk(fit.where("vec_id = 50"), fit, 5).orderBy("rank").collect()] == [(50, 1, 51), (50, 2, 52)]
    pages = spark.createDataFrame([(1, None, 5), (2, "no url", 5), (3, "http://a.b.c/x", None), (4, "http://u@A.B.c:80/x/y?q", 5), (4, "http://u@A.B.c:80/x/y?q", 5)], "page_id long, url string, fetched_at long")
    entries = spark.createDataFrame([("l", "b.c", 1, "add"), ("l", "b.c", 5, "remove"), ("m", "a.b.c/x", 5, "add"), ("m", "a.b.c/x", 5, "add"), (None, "b.c", 1, "add")], "list string, pattern string, at long, action string")
    for threshold in ("10MB", "-1"):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        got = {r["page_id"]: r["lists"] for r in url_filter.active_entries(pages, entries, ["allow"]).collect()}
        assert got == {1: [], 2: [], 3: [], 4: ["m"]}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10MB")


def test_decontaminate_looks_at_every_window(spark):
    r = random.Random(10)
    said = lambda k: ["".join(r.choice("abcdefghij") for _ in range(7)) for _ in range(k)]
    bags = lambda w: Counter(tuple(w[i:i + 5]) for i in range(max(len(w) - 4, 1)))
    items, docs = [], []
    for n, edge, inside in [(104, 3, 5), (59, 1, 2), (104, 3, 3), (104, 0, 0), (80, 2, 3), (40, 5, 9)]:
        item = said(n)
        middle = r.randint(20, n - 20)
        body = said(edge) + item[edge:middle] + said(inside) + item[middle:n - edge] + said(edge)
        items.append((len(items), item))
        docs += [(len(docs), said(50) + body + said(50)), (len(docs) + 1, body)]
    want = {}
    for d, words in docs:
        for i, item in items:
            own, best = bags(item), (0.0, 0)
            size = sum(own.values())
            n = len(words) - 4
            for start in range(max(n - size, 0) + 1):
                window = bags(words[start:start + size + 4])
                same = sum((window & own).values())
                best = max(best, (same / (sum(window.values()) + size - same), -start))
            if best[0] >= 0.8:
                want[d, i] = best[0]
    frame = lambda rows, name: spark.createDataFrame([(i, " ".join(w)) for i, w in rows], f"{name} long, text string")
    got = {(x["doc_id"], x["item_id"]): x["similarity"] for x in decontaminate.contaminated(frame(docs, "doc_id"), frame(items, "item_id")).collect()}
    assert got == want and {(0, 0), (2, 1), (6, 3)} <= set(want)


def test_pipeline_stages(spark, sf_dir):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["suffix_dedup"](spark, docs.withColumn("extra", F.lit(1)), sf_dir)
    assert kept.columns == [*docs.columns, "extra"]
    left = stages["decontaminate"](spark, docs, sf_dir)
    assert left.columns == docs.columns and 0 < left.count() <= docs.count()
    mixed = stages["mix_sources"](spark, docs, sf_dir)
    assert mixed.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 2


def test_pipeline_rejects_texts_like_no_language(spark, sf_dir):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    r, docs = random.Random(8), spark.read.parquet(f"{sf_dir}/documents.parquet")
    letters = lambda choose: " ".join("".join(choose() for _ in range(r.randint(2, 9))) for _ in range(12))
    unseen = [letters(lambda: chr(r.randrange(0x10A0, 0x10C5))) for _ in range(150)]
    noise = [letters(lambda: r.choice("abcdefghijklmnopqrstuvwxyz")) for _ in range(150)]
    clean = [" ".join(x["text"].split()[:10]) for x in docs.where("lang IS NOT NULL AND text IS NOT NULL").orderBy("doc_id").limit(150).collect()]
    added = [(10**9 + i, t) for i, t in enumerate(unseen + noise + clean)]
    more = spark.createDataFrame(added, "doc_id long, text string")
    kept = {x["doc_id"] for x in dict(corpus_pipeline.STAGES)["language_id"](spark, docs.unionByName(more, allowMissingColumns=True), sf_dir).select("doc_id").collect()}
    share = lambda a, b: sum(10**9 + i in kept for i in range(a, b)) / (b - a)
    assert share(0, 150) <= 0.01 and share(150, 300) <= 0.03 and share(300, 450) >= 0.97
    assert len([i for i in kept if i < 10**9]) >= 0.99 * docs.where("text IS NOT NULL AND doc_id IS NOT NULL").count()


def test_pipeline_compares_rows_without_an_id_of_their_own(spark, sf_dir):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    r, stages = random.Random(9), dict(corpus_pipeline.STAGES)
    said = lambda n: " ".join("".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    a, b, c, passage = said(60), said(60), said(60), said(30)
    item = max((x["text"] for x in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect() if x["text"]), key=len)
    rows = [(5, a), (None, a), (7, b), (7, b), (None, c), (None, c), (9, said(40) + " " + passage), (None, said(40) + " " + passage), (7, said(50)), (None, item), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(x["key"] for x in corpus_pipeline.keyed(docs).collect())[:3] == [5, 7, 9] and corpus_pipeline.keyed(docs).select("key").distinct().count() == len(rows)
    left = [tuple(x) for x in stages["jaccard_join"](spark, docs, sf_dir).collect()]
    assert sorted(left, key=str) == sorted([x for i, x in enumerate(rows) if i not in (1, 3, 5)], key=str)
    cut = [tuple(x) for x in stages["suffix_dedup"](spark, docs, sf_dir).collect()]
    assert sum(passage in (t or "") for _, t in cut) == 1 and [i for i, t in cut if t == a] == [5]
    assert sum(t == b for _, t in cut) == 1 and sum(t == c for _, t in cut) == 1
    clean = [tuple(x) for x in stages["decontaminate"](spark, docs, sf_dir).collect()]
    assert sorted(clean, key=str) == sorted([x for x in rows if x[1] != item], key=str)


def test_pipeline_stages_carry_columns_of_any_name(spark, sf_dir):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60)
    names = ["key", "_key", "row", "hash", "number", "first", "a.b", "b`c", "kept", "no_text", "id", "states"]
    more = docs.select("*", *[F.concat(F.lit(f"{n} "), F.col("doc_id").cast("string")).alias(n) for n in names])
    more = more.unionByName(more.limit(2)).unionByName(more.limit(1).withColumn("doc_id", F.lit(None).cast("bigint")))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, more, sf_dir)
        assert out.columns == more.columns and out.count() > 0, name
        assert all(x[n] == f"{n} {x['doc_id']}" for x in out.collect() for n in names if x["doc_id"] is not None), name


def test_pipeline_runs_its_stages_in_a_row_and_leaves_one_table_of_documents(spark, sf_dir):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    from bitquilt.session import cut, scratch_root

    before = set(os.listdir(scratch_root(spark)))
    got = corpus_pipeline.run(spark, sf_dir)
    left = {x.rsplit("-", 1)[0] for x in set(os.listdir(scratch_root(spark))) - before}
    assert not left & {"language_id", "jaccard_join", "suffix_dedup"}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        docs = cut(stage(spark, docs, sf_dir), "by_hand")
    # copies that the mix takes twice are rows of their own
    rows = lambda df: sorted(tuple(map(str, x)) for x in df.collect())
    assert rows(got) == rows(docs) and docs.count() > 0
