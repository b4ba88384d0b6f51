"""Token ids in binary files against the tokenizer library and exact round trips."""

import random
import unicodedata
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from bitquilt.llm import queries, token_ids

VOCABULARY = queries.vocabulary("word_bpe_49k.json")
SCHEMA = "doc_id bigint, text string"


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(VOCABULARY)


def expected(rows: list[tuple], end_id: int = 2) -> list[tuple]:
    """By the library, whole text by whole text; rows already in file order."""
    tokenizer, start, out = library(), 0, []
    for doc_id, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, end_id]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_code_round_trip():
    r = np.random.default_rng(1)
    for n in (0, 1, 3, 4, 5, 1000):
        ranks = (r.integers(0, 1 << 32, n, dtype=np.uint64) >> r.integers(0, 33, n).astype(np.uint64)).astype(np.uint32)
        control, data = token_ids.pack_ranks(ranks)
        assert (token_ids.unpack_ranks(control, data, n) == ranks).all() and len(control) == -(-n // 4)
        assert len(data) == sum(max(1, (int(x).bit_length() + 7) // 8) for x in ranks)


def test_words_have_the_ids_of_the_text():
    r, encoder, tokenizer = random.Random(2), token_ids.WordIds(VOCABULARY), library()
    bits = ["The", " ", "\n", "\t", "\x0b", "\x0c", "\x1c", "\x85", " ", " ", "don't", "It's.", "H", "̱", "é", ".", ",;", "!?", "'s", "'", "12", "A1.5", "日本", "😀",
            "<|endoftext|>", "<|ENDOFTEXT|>", "<|end", "|>", "ß", "İ", "Σ", "ﬁ", "​", "\x00", "ñ.", "x" * 70]
    texts = ["".join(r.choice(bits) for _ in range(r.randint(0, 12))) for _ in range(3000)]
    data = [t.encode() for t in texts]
    ids, counts = encoder.encode(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)]), 2)
    want = [[*e.ids, 2] for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert counts.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


def test_only_combining_marks_in_two_bytes_join_ascii_letters():
    pairs = [unicodedata.decomposition(chr(c)).split() for c in range(0x110000) if unicodedata.decomposition(chr(c))[:1] not in ("", "<")]
    seconds = {int(p[1], 16) for p in pairs if len(p) == 2 and int(p[0], 16) < 128 and chr(int(p[0], 16)).isalnum()}
    assert seconds and {chr(c).encode()[0] for c in seconds} <= {0xCC, 0xCD}


@pytest.mark.parametrize("kept", [1_000_000, 1])
def test_query_equals_library(spark, sf_dir, monkeypatch, kept):
    monkeypatch.setattr(token_ids, "KNOWN_WORDS", kept)
    rows = [tuple(x) for x in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()]
    assert sorted(map(tuple, queries.QUERIES["op11_token_ids"](spark, sf_dir).collect())) == expected(rows)


def test_odd_rows(spark, tmp_path):
    rows = [(7, "same"), (7, "same"), (None, "no id"), (5, None), (3, ""), (4, "   "), (-2, "w" * 30_000), (9, "long " * 50_000), (8, "\n")]
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({"ids": F.lit("x"), "start": F.lit(1), "a.b": F.lit(2)})
    token_ids.write_token_ids(docs, VOCABULARY, str(tmp_path / "odd"), 2)
    got = sorted(map(tuple, token_ids.read_token_ids(spark, str(tmp_path / "odd")).select("doc_id", "start", "n_tokens", F.crc32("ids")).collect()), key=lambda x: x[1])
    assert got == expected(sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0)))
    token_ids.write_token_ids(docs.limit(0), VOCABULARY, f"file://{tmp_path}/none")
    assert token_ids.read_token_ids(spark, f"file://{tmp_path}/none").collect() == []


def test_frequent_ids_have_low_ranks(spark, tmp_path):
    docs = spark.createDataFrame([(i, "the the the of of and") for i in range(50)], SCHEMA)
    token_ids.write_token_ids(docs, VOCABULARY, str(tmp_path / "ranks"))
    ids = library().encode("the of and", add_special_tokens=False).ids
    assert token_ids.read_ranks(str(tmp_path / "ranks"))[:3].tolist() == ids
    sizes = sum(f.stat().st_size for f in (tmp_path / "ranks").glob("*.ids"))
    assert sizes < 50 * 6 * 1.25 + 50 * 17 + 40 * 32 + 40 * 8
