"""op2's operator: token ids put together from pieces, text read from a table of bytes, and what travels."""

import random

import numpy as np
import pyarrow as pa
import pytest

from bitquilt.llm import chat_tree, queries

SCHEMA = "conv_id long, turn long, role string, text string"
PARTS = [*"ab Zé ñ \n\n  \t.,;:!?'\"-#<\\12٣中文αβ́  \x00\x1c\x85　ªº×÷😀|​\r\x0b", "'s", "'ll", " 's", "<|endoftext|>", "don't", "word ", "los", " \n"]


@pytest.fixture
def texts():
    r = random.Random(2)
    return ["".join(r.choice(PARTS) for _ in range(r.randint(0, 14))) for _ in range(6000)] + ["x" * 5000 + " end"]


def test_ids_of_pieces_are_those_of_the_text(texts, monkeypatch):
    path = queries.vocabulary()
    library = chat_tree.encoder(path)
    want = [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]
    for most in (chat_tree.KNOWN_PIECES, 100):
        monkeypatch.setattr(chat_tree, "KNOWN_PIECES", most)
        monkeypatch.setattr(chat_tree, "_known", {})
        assert [ids for i in range(0, len(texts), 500) for ids in chat_tree.encode(path, texts[i:i + 500])] == want
        assert len(chat_tree._known[path]) <= most and max(map(len, chat_tree._known[path])) <= chat_tree.KNOWN_LETTERS


def test_the_library_is_asked_once_for_a_piece(monkeypatch):
    path, asked = queries.vocabulary(), []
    library = chat_tree.encoder(path)

    class Counted:
        def encode_batch_fast(self, texts, **options):
            asked.extend(texts)
            return library.encode_batch_fast(texts, **options)

    monkeypatch.setattr(chat_tree, "_known", {})
    monkeypatch.setattr(chat_tree, "encoder", lambda _: Counted())
    for _ in range(2):
        chat_tree.encode(path, ["one two, two.\nOne one", "two, one two"])
    assert sorted(asked) == sorted(["one", " two", ",", ".", "\n", "One", " one", "two"])


def test_tokens_are_read_back(texts):
    path = queries.vocabulary()
    ids, others = chat_tree.encode(path, texts), chat_tree.encode(path, texts[::-1])
    starts, sizes = (np.array([len(x) for x in rows])[3:] for rows in (others, ids))
    tokens = pa.array([x + y for x, y in zip(others, ids, strict=True)], pa.list_(pa.int32()))[3:]
    whole, part = chat_tree.decode(path, tokens, starts, starts + sizes)
    assert whole.to_pylist() == [x + y for x, y in zip(texts[::-1], texts, strict=True)][3:] and part.to_pylist() == texts[3:]
    library = chat_tree.encoder(path)
    assert whole.to_pylist() == library.decode_batch(tokens.to_pylist(), skip_special_tokens=False)
    assert set(chat_tree.decode(path, tokens, starts, starts)[1].to_pylist()) == {""}


def test_a_task_tells_equal_conversations_once(spark):
    rows = [(c, t, "user", f"turn {t} of {c % 3}") for c in range(90) for t in range(3)]
    given = spark.createDataFrame(rows, SCHEMA).coalesce(1)
    paths = chat_tree.turn_paths(given)
    assert paths.count() == 90 and paths.where("turns IS NOT NULL").count() <= 3 * paths.rdd.getNumPartitions() < 90
    sequence, members = chat_tree.prefix_tree(given, queries.vocabulary())
    assert sequence.count() == 9 and members.count() == 90


def test_reading_back_stores_and_joins_no_tokens(spark, monkeypatch):
    rows = [(c, t, "user", f"turn {t if t < 2 else c}") for c in range(20) for t in range(4)]
    sequence, members = chat_tree.prefix_tree(spark.createDataFrame(rows, SCHEMA), queries.vocabulary())
    written = []
    monkeypatch.setattr(chat_tree, "cut", lambda df, name="stage": written.append(name) or df)
    assert chat_tree.conversation_digests(sequence, members, queries.vocabulary()).count() == 20 and not written
    plan = chat_tree.read_turns(sequence, queries.vocabulary())._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan
