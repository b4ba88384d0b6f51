"""Chat formatting as a prefix tree: shared first turns are emitted once, with positions and ancestor intervals."""

from __future__ import annotations

import hashlib
import os
import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.constants import const_array
from ..session import cut
from .common import salted_lookup
from .token_counts import byte_alphabet

#: The template: "### role: text</turn>\n". A backslash stands before every \, # and < of a text, and : of a role.
CLOSE = "</turn>\n"
TURN = re.compile(r"### ((?:[^\\:]++|\\.)*+): ((?:[^\\<]++|\\.)*+)</turn>\n", re.DOTALL)
ESCAPED = re.compile(r"\\(.)", re.DOTALL)
#: The role whose texts carry the loss.
LEARNED = "assistant"
#: Conversations handled at once inside a task.
ROWS = 64
#: Parts of a text that the byte-level pattern never joins with what follows: a Latin word, marks, one line end before a
#: word, else all up to the next space before a character. It does not look back, so ids of a text are those of its parts.
LATIN = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"
PIECE = re.compile(rf"(?s: ?[{LATIN}]++(?=[ \n.,;:!?]|\Z)|[.,;:!?]++(?=[ \n{LATIN}]|\Z)|\n(?=[{LATIN}])|.(?:[^ ]++| (?!\S))*+)")
#: Pieces whose ids a worker keeps, and their longest; others are asked of the library anew, which costs time only.
KNOWN_PIECES, KNOWN_LETTERS = 500_000, 48
#: Conversations that a task remembers; beyond it equal ones tell their turns again, which costs time only.
SEEN = 500_000
NODES = (
    "node string, leaf string, depth int, first boolean, run_at bigint, run_no bigint, at bigint, no bigint, tokens array<int>, loss_start int, loss_end int, above array<string>"
)
NODE_TYPES = [pa.string(), pa.string(), pa.int32(), pa.bool_(), *[pa.int64()] * 4, pa.list_(pa.int32()), pa.int32(), pa.int32(), pa.list_(pa.string())]
SPANS = "array<struct<start:bigint,end:bigint,turn:bigint,turns:bigint>>"
_encoders: dict = {}
_known: dict[str, dict[str, tuple[int, ...]]] = {}
_ids: dict[int, int] = {}
_pieces: dict[str, pa.Array] = {}


def encoder(path: str):
    if path not in _encoders:
        # a task has one core: a thread for each core of the machine would only keep that many caches and buffers
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _encoders[path] = Tokenizer.from_file(path)
        _encoders[path].encode_special_tokens = True
    return _encoders[path]


def encode(path: str, texts: list[str]) -> list[list[int]]:
    """Token ids of each text. The library encodes the pieces that are not known."""
    known, model = _known.setdefault(path, {}), encoder(path)
    pieces = [PIECE.findall(x) for x in texts]
    new = sorted(set().union(*pieces).difference(known), key=len)
    room = min(max(0, KNOWN_PIECES - len(known)), bisect_right(new, KNOWN_LETTERS, key=len))
    # one object for each id, so that a piece holds no copies
    known.update(zip(new, (tuple(map(_ids.setdefault, x.ids, x.ids)) for x in model.encode_batch_fast(new, add_special_tokens=False)), strict=True))
    found = [list(chain.from_iterable(map(known.__getitem__, own))) for own in pieces]
    # the pieces that come first are mostly the frequent ones: they stay
    for p in new[room:]:
        del known[p]
    return found


def token_bytes(path: str) -> pa.Array:
    """The bytes of each token, by id."""
    if path not in _pieces:
        byte = {c: b for b, c in byte_alphabet().items()}
        by_id = {i: bytes(byte[c] for c in t) for t, i in encoder(path).get_vocab(with_added_tokens=True).items()}
        _pieces[path] = pa.array([by_id.get(i) for i in range(max(by_id) + 1)], pa.large_binary())
    return _pieces[path]


def decode(path: str, tokens: pa.ListArray, starts: np.ndarray, ends: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """The text of each row's tokens, and of those from `starts` to `ends` among them."""
    offsets = tokens.offsets.to_numpy().astype(np.int64)
    parts = token_bytes(path).take(tokens.values.slice(offsets[0], offsets[-1] - offsets[0]))
    offsets -= offsets[0]
    # every second list is what lies between
    spans = np.append(np.stack([offsets[:-1] + starts, offsets[:-1] + ends], axis=1).ravel(), offsets[-1])
    joined = lambda at: pc.binary_join(pa.LargeListArray.from_arrays(at, parts), pa.scalar(b"", pa.large_binary()))
    return joined(offsets).cast(pa.large_string()), joined(spans)[::2].cast(pa.large_string())


def turns_of(rows: pa.ListArray) -> list[list[tuple[str, str, bool]]]:
    """(head, body, learned) of the turns of each row."""
    flat, offsets = rows.flatten(), (rows.offsets.to_numpy() - rows.offsets[0].as_py()).tolist()
    turns = list(zip(*(flat.field(c).to_pylist() for c in ("head", "body", "learned")), strict=True))
    return [turns[a:b] for a, b in zip(offsets, offsets[1:], strict=False)]


def escape(text: Column, marks: str = "#<") -> Column:
    return F.regexp_replace(text, rf"([\\{marks}])", r"\\$1")


def turn_paths(conversations: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, turns (head, body, learned) and keys, the name of each prefix of its turns.

    Turns stand by turn (null first), equal ones by role and text; a null role or text is empty. Rows of one conversation
    are one training sample and meet in one task; nothing else does. Rows of a null conv_id are one conversation.
    Of equal conversations in a task the first has the turns, the others null, so that not all travel on.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", role.alias("role"), text.alias("text")))).alias("turns"))
    formatted = F.transform("turns", lambda t: F.struct(
        F.concat(F.lit("### "), escape(t["role"], "#<:"), F.lit(": ")).alias("head"), escape(t["text"]).alias("body"), (t["role"] == LEARNED).alias("learned")))
    rows = turns.select("conv_id", formatted.alias("turns"))

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[str] = set()
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                keys = []
                for said in turns_of(part.column("turns")):
                    # one running hash: after each turn it names all turns so far
                    running, own = hashlib.blake2b(digest_size=16), []
                    for head, body, _ in said:
                        running.update((head + body + CLOSE).encode("utf-8", "surrogatepass"))
                        own.append(running.hexdigest())
                    keys.append(own)
                told = []
                for i, own in enumerate(keys):
                    told.append(None if own[-1] in seen else i)
                    seen.add(own[-1])
                if len(seen) > SEEN:
                    seen.clear()
                yield pa.RecordBatch.from_arrays([part.column("conv_id"), part.column("turns").take(pa.array(told, pa.int64())), pa.array(keys, pa.list_(pa.string()))], names=["conv_id", "turns", "keys"])

    kinds = {c: rows.schema[c].dataType.simpleString() for c in rows.columns}
    return rows.mapInArrow(name, f"conv_id {kinds['conv_id']}, turns {kinds['turns']}, keys array<string>")


def emit_nodes(paths: DataFrame, path: str) -> DataFrame:
    """NODES of conversations in the order of their keys: each turn that the one before does not share, so none of an equal one.

    That order is depth-first, so one pass over a sorted range merges it. What the first conversation of a range shares
    with the range before is not known here: all its turns are emitted, marked `first`. Two rows of edges (depth -1
    and 0, keys in `above`) tell each range's first and last conversation.
    """
    names = [x.split(" ")[0] for x in NODES.split(", ")]

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        close = encode(path, [CLOSE])[0]
        before, n_tokens, n_nodes = None, 0, 0
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                rows, new = [], []
                for keys, turns in zip(part.column("keys").to_pylist(), turns_of(part.column("turns")), strict=True):
                    shared, first = 0, before is None
                    if first:
                        rows.append((None, keys[-1], -1, True, 0, 0, 0, 0, None, None, None, keys))
                    else:
                        least = min(len(before), len(keys))
                        while shared < least and before[shared] == keys[shared]:
                            shared += 1
                    new.append((keys, turns, shared, first))
                    before = keys
                ids = iter(encode(path, [x for _, turns, shared, _ in new for head, body, _ in turns[shared:] for x in (head, body)]))
                for keys, turns, shared, first in new:
                    run = (n_tokens, n_nodes)
                    for depth in range(shared, len(keys)):
                        head, body = next(ids), next(ids)
                        tokens, from_ = head + body + close, len(head)
                        above = keys[:shared] if depth == shared and shared else None
                        rows.append((keys[depth], keys[-1], depth + 1, first, *run, n_tokens, n_nodes, tokens, from_, from_ + len(body) if turns[depth][2] else from_, above))
                        n_tokens, n_nodes = n_tokens + len(tokens), n_nodes + 1
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), NODE_TYPES, strict=True)], names=names)
        if before is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((None, None, 0, True, 0, 0, 0, 0, None, None, None, before), NODE_TYPES, strict=True)], names=names)

    ranged = paths.repartitionByRange("keys").sortWithinPartitions("keys")
    return ranged.mapInArrow(emit, NODES).withColumn("range", F.spark_partition_id())


def place(stored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, links): nodes with their places in the whole sequence, and (leaf, ancestor) of what a run hangs on.

    A run is what one conversation adds to the sequence. The driver sees four numbers per range.
    """
    ends = [F.first(F.when(F.col("depth") == d, F.col("above")), ignorenulls=True).alias(c) for d, c in ((-1, "head"), (0, "tail"))]
    none = F.array().cast("array<string>")
    last = F.lag("tail").over(Window.orderBy("range"))
    edges = cut(stored.where("depth < 1").groupBy("range").agg(*ends).withColumn("shared", F.size(F.array_intersect("head", F.coalesce(last, none)))), "edges")
    shared = {r["range"]: r["shared"] for r in edges.select("range", "shared").collect()}
    ranges = range(max(shared, default=-1) + 1)
    known = F.col("first") & (F.col("depth") <= const_array([shared.get(r, 0) for r in ranges] or [0], "int")[F.col("range")])
    size = F.size("tokens").cast("bigint")
    total = [F.sum(F.when(c, v).otherwise(0)).alias(n) for n, c, v in (("kept", ~known, size), ("gone", known, size), ("nodes", ~known, F.lit(1)))]
    sums = {r["range"]: r for r in stored.where("depth > 0").groupBy("range").agg(*total).collect()}
    floors, shifts, n_floors, n_shifts, at, n_at = [], [], [], [], 0, 0
    for r in ranges:
        floors, n_floors = [*floors, at], [*n_floors, n_at]
        shifts, n_shifts = [*shifts, at - (sums[r]["gone"] if r in sums else 0)], [*n_shifts, n_at - shared.get(r, 0)]
        at, n_at = (at + sums[r]["kept"], n_at + sums[r]["nodes"]) if r in sums else (at, n_at)
    number = lambda values: const_array(values or [0], "bigint")[F.col("range")]
    nodes = stored.where("depth > 0").where(~known).select(
        "node", "leaf", "tokens", "loss_start", "loss_end", (F.col("at") + number(shifts)).alias("start"), (F.col("no") + number(n_shifts)).alias("turn"),
        F.greatest(F.col("run_at") + number(shifts), number(floors)).alias("run"), F.greatest(F.col("run_no") + number(n_shifts), number(n_floors)).alias("run_turn"))
    inside = stored.where("depth > 0 AND above IS NOT NULL").select("leaf", F.explode("above").alias("ancestor"))
    ahead = edges.select(F.element_at("head", -1).alias("leaf"), F.explode(F.slice("head", F.lit(1), F.col("shared"))).alias("ancestor"))
    return nodes, inside.union(ahead)


def prefix_tree(conversations: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """(sequence, members) of conversations (conv_id, turn, role, text).

    sequence, one row per distinct prefix of turns: turn (its number in the one depth-first sequence), start (of its
    tokens there), tokens, position (the id of its first token; the others follow: the length of the turns above it),
    ancestors (intervals [start, end) of the sequence, of `turns` turns from number `turn` on, that its tokens may attend
    to besides their own), loss_start, loss_end (inside tokens: the text of an assistant, else empty). members: conv_id,
    n_turns, start (of the conversation's last turn). Turns that follow one another on a path share an interval, so a
    long conversation costs one interval a turn, not one for each pair of turns. Conversations without rows do not
    exist; equal ones share all nodes; extra columns are not read.
    """
    paths = cut(turn_paths(conversations).withColumn("leaf", F.element_at("keys", -1)), "paths")
    stored = cut(emit_nodes(paths.where("turns IS NOT NULL").select("keys", "turns"), path), "tree")
    nodes, links = place(stored)
    spans = nodes.select(F.col("node").alias("ancestor"), "run", "run_turn", "turn", (F.col("start") + F.size("tokens")).alias("end"))
    # what a path takes of a run begins with the run
    taken = salted_lookup(links, spans, "ancestor", "leaf").groupBy("leaf", "run", "run_turn").agg(F.max("end").alias("end"), F.count("*").alias("turns"))
    interval = F.struct(F.col("run").alias("start"), "end", F.col("run_turn").alias("turn"), "turns")
    over = taken.groupBy("leaf").agg(F.sort_array(F.collect_list(interval)).alias("over"))
    none = F.array().cast(SPANS)
    own = F.array(F.struct(F.col("run").alias("start"), F.col("start").alias("end"), F.col("run_turn").alias("turn"), (F.col("turn") - F.col("run_turn")).alias("turns")))
    ancestors = F.concat(F.coalesce("over", none), F.when(F.col("start") > F.col("run"), own.cast(SPANS)).otherwise(none))
    length = F.aggregate("ancestors", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])
    sequence = nodes.join(over, "leaf", "left").withColumn("ancestors", ancestors).select("turn", "start", "tokens", length.alias("position"), "ancestors", "loss_start", "loss_end")
    ends = paths.select("conv_id", F.size("keys").cast("bigint").alias("n_turns"), "leaf")
    members = salted_lookup(ends, nodes.where("node = leaf").select("leaf", "start"), "leaf", "conv_id").select("conv_id", "n_turns", "start")
    return sequence, members


def read_turns(sequence: DataFrame, path: str) -> DataFrame:
    """Each row of the sequence read back from its tokens: turn, role, text, n_chars, loss_text."""
    schema = "turn bigint, role string, text string, n_chars bigint, loss_text string"

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain = lambda x: ESCAPED.sub(r"\1", x) if "\\" in x else x
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                whole, learned = decode(path, part.column("tokens"), part.column("loss_start").to_numpy(), part.column("loss_end").to_numpy())
                parsed = [TURN.fullmatch(x).groups() for x in whole.to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("turn"), pa.array([plain(r) for r, _ in parsed], pa.string()), pa.array([plain(t) for _, t in parsed], pa.string()),
                     pc.utf8_length(whole), pa.array([plain(x) for x in learned.to_pylist()], pa.string())],
                    names=["turn", "role", "text", "n_chars", "loss_text"])

    return sequence.select("turn", "tokens", "loss_start", "loss_end").mapInArrow(parse, schema)


def conversation_digests(sequence: DataFrame, members: DataFrame, path: str) -> DataFrame:
    """Per conversation, read back through the attention intervals of its last turn; equal ones are read once."""
    # the tokens are read where they are stored, the intervals apart from them: neither takes the other along
    leaves = sequence.join(members.select("start").distinct(), "start").select("start", "turn", "ancestors")
    above = F.flatten(F.transform("ancestors", lambda s: F.sequence(s["turn"], s["turn"] + s["turns"] - 1)))
    seen = leaves.select("start", F.explode(F.concat(above, F.array("turn"))).alias("turn"))
    read = salted_lookup(seen, read_turns(sequence, path), "turn", "start")
    rows = read.groupBy("start").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text", "n_chars", "loss_text"))).alias("turns"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform("turns", lambda t: t["loss_text"]), "")
    digests = rows.select(
        "start", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.char_length(loss).cast("bigint").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"),
        F.aggregate("turns", F.lit(0).cast("bigint"), lambda n, t: n + t["n_chars"]).alias("formatted_chars"),
    )
    return salted_lookup(members.select("conv_id", "start"), digests, "start", "conv_id").drop("start")


SQL = r"""
WITH given AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length(regexp_replace(role, '([\\#<:])', '\\\1', 'g')) + length(regexp_replace(text, '([\\#<])', '\\\1', 'g')) + 14)::BIGINT AS formatted_chars
FROM given GROUP BY conv_id
"""
