"""Removal of repeated byte strings with longest-previous-factor arrays over sorted suffixes.

Every byte of a document that is covered by a `length`-byte string which also starts in a document with a smaller id
goes; the first document keeps it. Suffixes are not sorted all at once: each window of `length` bytes has one anchor, a
short gram chosen by content, and equal windows have equal anchors. Three steps:

1. Fragments. Each anchor is sent, as hashes of its gram and of the bytes around it, to the task of its gram. There an
   anchor is covered (a smaller document has the same surroundings), free (no smaller document has the gram) or open.
2. Suffix order. The suffixes at the open anchors, and at the anchors they may match, are sorted by their first
   `length` bytes; previous and next smaller documents in that order give each suffix's longest previous factor.
3. Cutting. Covered windows become spans; the rest of the bytes is kept.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import cut
from .anchors import anchors
from .text import CHUNK_BYTES, byte_rows, mix, packed_rows, spans_of

LENGTH = 50
GRAM = 20
FREE, COVERED, OPEN, SOURCE = range(4)
LOW40 = np.uint64((1 << 40) - 1)
PACKED = "block bigint, fragment int, ids binary, sizes binary, keys binary, rest binary"


def narrow(values: np.ndarray) -> bytes:
    """The low five bytes of each word."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()


def widen(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(raw, np.uint8).reshape(-1, 5)
    return out.view("<u8").ravel()


class Entries:
    """Anchors of packed rows; an entry is a (row, gram, surroundings) that occurs, in the order of row, fragment, hashes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, fragments: int, length: int, gram: int) -> None:
        self.at, rolling = anchors(data, offsets, length, gram)
        row = np.searchsorted(offsets, self.at, "right") - 1
        self.lo = np.maximum(self.at - (length - gram), offsets[row])
        self.hi = np.minimum(self.at + length, offsets[row + 1])
        key = rolling.of(self.at, self.at + gram)
        around = rolling.of(self.lo, self.hi) ^ mix(((self.at - self.lo) * 1000 + (self.hi - self.at)).astype(np.uint64))
        fragment = ((key >> np.uint64(40)) % np.uint64(fragments)).astype(np.int64)
        small, rest = key & LOW40, mix(around)  # all 64 bits: equal grams have nothing else to tell them apart
        order = np.lexsort((rest, small, fragment, row))
        sorted_ = [x[order] for x in (row, fragment, small, rest)]
        first = np.ones(len(order), bool)
        first[1:] = np.any([x[1:] != x[:-1] for x in sorted_], axis=0)
        self.row, self.fragment, self.key, self.rest = (x[first] for x in sorted_)
        self.entry_of = np.empty(len(order), np.int64)  # of each anchor
        self.entry_of[order] = np.cumsum(first) - 1
        self.sample = order[first]  # an anchor of each entry


def pack(docs: DataFrame, fragments: int, length: int, gram: int) -> DataFrame:
    """Blocks of documents cut by fragment: per block and fragment the entries that the block can't decide itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        serial = TaskContext.get().partitionId() << 24
        for batch in batches:
            ids, hashes = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
            for a, b, data, offsets in packed_rows(batch.column(2), 2 * CHUNK_BYTES):
                e = Entries(data, offsets, fragments, length, gram)
                doc = ids[a:b][e.row]
                # within the block, equal surroundings in a smaller document already cover
                order = np.lexsort((doc, e.rest, e.key, e.fragment))
                head = np.ones(len(order), bool)
                head[1:] = (e.key[order][1:] != e.key[order][:-1]) | (e.rest[order][1:] != e.rest[order][:-1]) | (e.fragment[order][1:] != e.fragment[order][:-1])
                least = np.empty(len(order), np.int64)
                least[order] = doc[order][head][np.cumsum(head) - 1] if len(order) else 0
                covered = doc > least
                yield _packed(serial, -1, ids[a:b].tobytes() + hashes[a:b].tobytes(), np.bincount(e.row, minlength=b - a).astype(np.int32).tobytes(), np.packbits(covered).tobytes(), b"")
                for f in np.unique(e.fragment[~covered]).tolist():
                    take = ~covered & (e.fragment == f)
                    present, counts = np.unique(e.row[take], return_counts=True)
                    yield _packed(serial, f, ids[a:b][present].tobytes(), np.stack([present, counts]).astype(np.int32).tobytes(), narrow(e.key[take]), e.rest[take].astype("<u8").tobytes())
                serial += 1

    return docs.where(F.col("doc_id").isNotNull() & (F.octet_length("text") >= length)).select("doc_id", "text_hash", "text").mapInArrow(run, PACKED)


def _packed(*values) -> pa.RecordBatch:
    types = [pa.int64(), pa.int32(), *[pa.binary()] * 4]
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types, strict=True)], names=[x.split(" ")[0] for x in PACKED.split(", ")])


def decide(table: pa.Table) -> pa.Table:
    """States of all entries of one fragment; the rows of the blocks themselves pass through."""
    t = table.combine_chunks()
    fragment = t["fragment"].to_numpy()
    mine = np.flatnonzero(fragment >= 0)
    rest_out = t["rest"].to_pylist()
    if len(mine):
        get = lambda c: [t[c][int(i)].as_py() for i in mine]
        counts = [np.frombuffer(x, np.int32).reshape(2, -1)[1] for x in get("sizes")]
        doc = np.concatenate([np.repeat(np.frombuffer(i, np.int64), c) for i, c in zip(get("ids"), counts, strict=True)])
        # several fragments may share a task group: the fragment is part of the gram
        sizes = [int(c.sum()) for c in counts]
        key = np.concatenate([widen(x) for x in get("keys")]) | np.repeat(fragment[mine].astype(np.uint64) << np.uint64(40), sizes)
        around = np.concatenate([np.frombuffer(x, "<u8") for x in get("rest")])
        state = states(doc, key, around)
        at = 0
        for i, n in zip(mine.tolist(), sizes, strict=True):
            rest_out[i] = state[at:at + n].tobytes()
            at += n
    keys = pa.array([k if f < 0 else b"" for k, f in zip(t["keys"].to_pylist(), fragment.tolist(), strict=True)], pa.binary())
    ids = pa.array([k if f < 0 else b"" for k, f in zip(t["ids"].to_pylist(), fragment.tolist(), strict=True)], pa.binary())
    return pa.table({"block": t["block"], "fragment": t["fragment"], "ids": ids, "sizes": t["sizes"], "keys": keys, "rest": pa.array(rest_out, pa.binary())})


def states(doc: np.ndarray, key: np.ndarray, around: np.ndarray) -> np.ndarray:
    """FREE, COVERED, OPEN or SOURCE (free itself, but an open entry may match it) of each entry."""
    order = np.lexsort((doc, around, key))
    k, a, d = key[order], around[order], doc[order]
    new_key = np.ones(len(k), bool)
    new_key[1:] = k[1:] != k[:-1]
    new_pair = new_key.copy()
    new_pair[1:] |= a[1:] != a[:-1]
    group = np.cumsum(new_key) - 1
    least_pair = d[new_pair][np.cumsum(new_pair) - 1]
    least_key = np.minimum.reduceat(d, np.flatnonzero(new_key))[group] if len(d) else d
    covered = d > least_pair
    open_ = ~covered & (d > least_key)
    wanted = np.bincount(group[open_], minlength=int(group[-1]) + 1 if len(group) else 0) > 0
    out = np.where(covered, COVERED, np.where(open_, OPEN, np.where(wanted[group] if len(group) else covered, SOURCE, FREE))).astype(np.uint8)
    back = np.empty_like(out)
    back[order] = out
    return back


def assemble(table: pa.Table) -> pa.Table:
    """Per document of a block with anything to do, the states of its entries in their order."""
    t = table.combine_chunks()
    fragment = t["fragment"].to_numpy()
    top = int(np.flatnonzero(fragment == -1)[0])
    head = np.frombuffer(t["ids"][top].as_py(), np.int64)
    n = len(head) // 2
    counts = np.frombuffer(t["sizes"][top].as_py(), np.int32)
    total = int(counts.sum())
    covered = np.unpackbits(np.frombuffer(t["keys"][top].as_py(), np.uint8))[:total].astype(bool)
    rows, values = [], []
    for i in sorted(np.flatnonzero(fragment >= 0).tolist(), key=lambda i: fragment[i]):
        present, own = np.frombuffer(t["sizes"][i].as_py(), np.int32).reshape(2, -1)
        rows.append(np.repeat(present, own))
        values.append(np.frombuffer(t["rest"][i].as_py(), np.uint8))
    state = np.full(total, COVERED, np.uint8)
    if rows:
        state[~covered] = np.concatenate(values)[np.argsort(np.concatenate(rows), kind="stable")]
    ends = np.cumsum(counts)
    busy = [i for i in range(n) if state[ends[i] - counts[i]:ends[i]].any()]
    return pa.table({
        "doc_id": pa.array(head[:n][busy], pa.int64()), "text_hash": pa.array(head[n:][busy], pa.int64()),
        "states": pa.array([state[ends[i] - counts[i]:ends[i]].tobytes() for i in busy], pa.binary()),
    })


def window_rows(data: np.ndarray, e: Entries, chosen: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Entry and start of every window of `length` bytes around the sample anchors of the chosen entries."""
    lo, hi = e.lo[e.sample[chosen]], e.hi[e.sample[chosen]]
    n = hi - lo - length + 1
    entry = np.repeat(chosen, n)
    within = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    return entry, np.repeat(lo, n) + within


CONTEXT = "place int, doc_id bigint, text_hash bigint, entry int, shift int, around binary"


def contexts(busy: DataFrame, fragments: int, groups: int, length: int, gram: int, keep: list[str]) -> DataFrame:
    """The bytes around open anchors and their possible sources, placed by gram.

    `keep`: columns that are read and not used, so that the rows come from the same exchange as those of the cutting.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hashes = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            states_ = batch.column(3).to_pylist()
            for a, b, data, offsets in packed_rows(batch.column(2)):
                e = Entries(data, offsets, fragments, length, gram)
                state = np.frombuffer(b"".join(states_[a:b]), np.uint8)
                chosen = np.flatnonzero(state >= OPEN)
                first = np.searchsorted(e.row, np.arange(b - a))
                lo, hi = e.lo[e.sample[chosen]], e.hi[e.sample[chosen]]
                raw = data.tobytes()
                row = a + e.row[chosen]
                place = (mix(e.key[chosen] ^ (e.fragment[chosen].astype(np.uint64) << np.uint64(40))) % np.uint64(groups)).astype(np.int32)
                # a source needs no answer: its entry is sent as -1
                entry = np.where(state[chosen] == OPEN, chosen - first[e.row[chosen]], -1)
                yield pa.RecordBatch.from_arrays([
                    pa.array(place), pa.array(ids[row], pa.int64()), pa.array(hashes[row], pa.int64()), pa.array(entry, pa.int32()),
                    pa.array(e.at[e.sample[chosen]] - lo, pa.int32()), pa.array([raw[x:y] for x, y in zip(lo.tolist(), hi.tolist(), strict=True)], pa.binary()),
                ], names=[x.split(" ")[0] for x in CONTEXT.split(", ")])

    return busy.select("doc_id", "text_hash", "text", "states", *keep).mapInArrow(run, CONTEXT)


def smaller_neighbours(values: np.ndarray, same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Previous and next position with a smaller value, within runs (`same`: run number, rising); -1 where there is none."""
    n = len(values)

    def jump(v: np.ndarray, run: np.ndarray) -> np.ndarray:
        at = np.arange(-1, n - 1)
        live = np.arange(n)
        while len(live):
            to = at[live]
            ok = (to >= 0) & (run[np.maximum(to, 0)] == run[live])
            at[live[~ok]] = -1
            live, to = live[ok], to[ok]
            go = v[to] >= v[live]
            live = live[go]
            at[live] = at[to[go]]
        return at

    before = jump(values, same)
    after = jump(values[::-1], same[::-1])[::-1]
    return before, np.where(after >= 0, n - 1 - after, -1)


def previous_factors(windows: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Whether the longest previous factor of each suffix, capped at the window length, has that length.

    windows: the first bytes of the suffixes as fixed-length strings; positions are ordered by document.
    """
    order = np.lexsort((doc, windows))
    w, d = windows[order], doc[order]
    fresh = np.ones(len(w), bool)
    fresh[1:] = w[1:] != w[:-1]
    run = np.cumsum(fresh)
    before, after = smaller_neighbours(d, run)
    out = np.empty(len(w), bool)
    out[order] = (before >= 0) | (after >= 0)
    return out


#: Windows that are sorted at once; a gram's windows always stay together.
SORTED_ROWS = 400_000
MASKS = "doc_id bigint, text_hash bigint, entry int, windows bigint"


def suffix_group(length: int):
    def run(table: pa.Table) -> pa.Table:
        t = table.combine_chunks()
        data, starts, ends = byte_rows(t["around"])
        doc, entry, shift = (t[c].to_numpy() for c in ("doc_id", "entry", "shift"))
        masks = np.zeros(len(doc), np.int64)
        # equal windows have equal grams at their anchor: rows may be handled gram by gram
        grams = np.array([data[s + x:s + x + 8].tobytes() for s, x in zip(starts.tolist(), shift.tolist(), strict=True)], "S8")
        order = np.argsort(grams, kind="stable")
        fresh = np.ones(len(order), bool)
        fresh[1:] = grams[order][1:] != grams[order][:-1]
        heads = np.append(np.flatnonzero(fresh), len(order))
        n = ends - starts - length + 1
        for a, b in spans_of(np.add.reduceat(n[order], heads[:-1]) if len(order) else n, SORTED_ROWS):
            rows = order[heads[a]:heads[b]]
            row = np.repeat(rows, n[rows])
            within = np.arange(len(row)) - np.repeat(np.cumsum(n[rows]) - n[rows], n[rows])
            at = starts[row] + within
            view = np.lib.stride_tricks.sliding_window_view(data, length)
            windows = np.ascontiguousarray(view[at]).view(f"S{length}").ravel()
            hit = previous_factors(windows, doc[row]) & (entry[row] >= 0)
            np.bitwise_or.at(masks, row[hit], np.int64(1) << within[hit])
        keep = masks != 0
        return pa.table({"doc_id": t["doc_id"].filter(pa.array(keep)), "text_hash": t["text_hash"].filter(pa.array(keep)), "entry": t["entry"].filter(pa.array(keep)), "windows": pa.array(masks[keep], pa.int64())})

    return run


def removed(length: int, row_bytes: np.ndarray, e: Entries, state: np.ndarray, entries: list, masks: list) -> np.ndarray:
    """Which bytes of one document go."""
    depth = np.zeros(len(row_bytes) + 1, np.int64)
    full = state[e.entry_of] == COVERED
    np.add.at(depth, e.lo[full], 1)
    np.add.at(depth, e.hi[full], -1)
    if entries:
        by_entry = np.zeros(len(state), np.int64)
        by_entry[entries] = masks
        mask = by_entry[e.entry_of]
        for bit in range(length - GRAM + 1):
            at = e.lo[(mask >> bit) & 1 == 1] + bit
            np.add.at(depth, at, 1)
            np.add.at(depth, at + length, -1)
    return np.cumsum(depth[:-1]) > 0


def remove_repeats(docs: DataFrame, length: int = LENGTH, keep_text: bool = False, keep: list[str] | None = None) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_bytes, n_removed, n_spans, kept_sha256, and with keep_text `kept`.

    Texts are UTF-8 bytes; a null text is empty; a text shorter than `length` loses nothing. Strings are judged on the
    input, never across documents. Only smaller ids cover: rows that repeat an id don't cover each other, and a row
    without an id neither loses nor covers anything. kept: the text without the characters all of whose bytes go.
    `keep` names further columns to carry along. Memory of a task is bounded by a block, a fragment or the rows of
    one gram group; blocks first merge equal surroundings, so copies cost a block one entry.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    fragments, groups = 2 * parts, 4 * parts
    keep = keep or []
    kept = [f"_keep_{c}" for c in keep]
    # keys without nulls: a join that drops rows and one that keeps them then ask for the same exchange of the texts
    text_hash = F.when(F.col("doc_id").isNull(), F.bitwise_not(F.xxhash64("text"))).otherwise(F.xxhash64("text"))
    hashed = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("bigint"), F.lit(0)).alias("id"), "text", text_hash.alias("text_hash"), *[F.col(c).alias(k) for c, k in zip(keep, kept, strict=True)])
    blocks = pack(hashed, fragments, length, GRAM)
    place = F.when(F.col("fragment") >= 0, F.col("fragment")).otherwise(F.pmod(F.col("block"), F.lit(fragments)).cast("int"))
    decided = blocks.groupBy(place.alias("place")).applyInArrow(decide, PACKED)
    states_ = decided.groupBy("block").applyInArrow(assemble, "doc_id bigint, text_hash bigint, states binary")
    states_ = cut(states_.groupBy(F.col("doc_id").alias("id"), "text_hash").agg(F.first("states").alias("states")), "states")
    # the only shuffle of texts: by id, used for the suffixes and again for the cutting
    texts = hashed.repartition(parts, "id", "text_hash")
    around = contexts(texts.join(states_.hint("merge"), ["id", "text_hash"]), fragments, groups, length, GRAM, kept)
    found = around.groupBy("place").applyInArrow(suffix_group(length), MASKS)
    masks = found.groupBy(F.col("doc_id").alias("id"), "text_hash").agg(F.collect_list(F.struct("entry", "windows")).alias("masks"))
    whole = texts.join(states_.hint("merge"), ["id", "text_hash"], "left").join(masks.hint("merge"), ["id", "text_hash"], "left")
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * keep_text
    schema = StructType([docs.schema["doc_id"]])
    for name in names[1:]:
        schema.add(name, "string" if name.startswith("kept") else "long")
    for name in keep:
        schema.add(docs.schema[name])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, starts, ends = byte_rows(batch.column(1))
            for a, b in spans_of(ends - starts, 4 * CHUNK_BYTES):
                state_rows = batch.column(2).slice(a, b - a).to_pylist()
                mask_rows = batch.column(3).slice(a, b - a).to_pylist()
                out = [[], [], [], [], []]
                for i in range(a, b):
                    row = data[starts[i]:ends[i]]
                    goes = np.zeros(len(row), bool)
                    if state_rows[i - a] is not None:
                        e = Entries(row, np.array([0, len(row)]), fragments, length, GRAM)
                        found = mask_rows[i - a] or []
                        goes = removed(length, row, e, np.frombuffer(state_rows[i - a], np.uint8), [m["entry"] for m in found], [m["windows"] for m in found])
                    left = row[~goes] if goes.any() else row
                    out[0].append(len(row))
                    out[1].append(int(goes.sum()))
                    out[2].append(int((np.diff(goes.astype(np.int8), prepend=0) == 1).sum()))
                    out[3].append(hashlib.sha256(left.tobytes()).hexdigest())
                    if keep_text:
                        out[4].append(kept_text(row, goes))
                types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                columns = [pa.array(x, t) for x, t in zip(out, types, strict=True)][:4 + keep_text]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *columns, *[batch.column(4 + j).slice(a, b - a) for j in range(len(keep))]], names=[*names, *keep])

    return whole.select("doc_id", "text", "states", "masks", *kept).mapInArrow(finish, schema)


def kept_text(row: np.ndarray, goes: np.ndarray) -> str:
    """The text without the characters that go whole."""
    if not goes.any():
        return row.tobytes().decode("utf-8", "replace")
    leads = np.flatnonzero((row & 0xC0) != 0x80)
    char = np.searchsorted(leads, np.arange(len(row)), "right") - 1
    stays = np.zeros(len(leads) + 1, bool)
    stays[char[~goes]] = True
    return row[stays[char]].tobytes().decode("utf-8", "replace")
