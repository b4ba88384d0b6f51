"""Exact Jaccard similarity join on word shingles with vertical partitioning.

The global order of shingles, rare ones first, is cut into fragments. Every set is cut with it: fragments count how
many sets hold each shingle, and shingles that no other set holds never travel again. Pairs that share a rare enough
shingle are candidates; their partial overlaps are counted fragment by fragment and summed per pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut, discard, fits_broadcast
from .common import salted_lookup
from .text import CHUNK_BYTES, mix, packed_rows, shingle_hashes, word_hashes

#: Link when PARTS * intersection >= NEEDED * union.
NEEDED, PARTS = 80, 100
#: The order of shingles is cut behind those that so many sets hold: overlaps are counted in one more fragments than cuts.
CUTS = (2, 4, 16)
#: Rounds with one hub per shingle before all remaining pairs of different groups are tried.
HUB_ROUNDS = 4
#: All remaining pairs are tried at once when there are at most this many for each entry.
FEW = 8
#: Holders of a shingle that are compared with each other in one task.
BUCKET = 1024
#: Words of 64 bits in a set's parity sketch, and sets sketched at once inside a task.
SKETCH, SKETCH_ROWS = 8, 2048
LOW48 = np.uint64((1 << 48) - 1)
PACKED = "block bigint, fragment int, head binary, sizes binary, tokens binary"
SETS = "doc_id bigint, sig_a bigint, sig_b bigint, n_shingles bigint, alone bigint, tokens array<bigint>, ends array<int>, sketch array<bigint>"


def narrow(values: np.ndarray) -> bytes:
    """The low six bytes of each word."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def widen(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def distinct_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each row, sorted, and the row of each."""
    words, bounds = word_hashes(data, offsets)
    found, at = shingle_hashes(words, bounds, k)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(at))
    order = np.lexsort((found, row))
    found, row = found[order], row[order]
    first = np.ones(len(found), bool)
    first[1:] = (found[1:] != found[:-1]) | (row[1:] != row[:-1])
    return found[first], row[first]


def pack(docs: DataFrame, fragments: int, k: int) -> DataFrame:
    """Blocks of documents whose sets are cut into fragments; equal sets of a block are sent once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        serial = TaskContext.get().partitionId() << 24
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for a, b, data, offsets in packed_rows(batch.column(1), 2 * CHUNK_BYTES):
                tokens, row = distinct_sets(data, offsets, k)
                sizes = np.bincount(row, minlength=b - a)
                starts = np.cumsum(sizes) - sizes
                full = np.flatnonzero(sizes)
                sig = np.zeros((2, b - a), np.uint64)
                with np.errstate(over="ignore"):
                    for i, salt in enumerate((0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)):
                        if len(full):
                            sig[i, full] = np.add.reduceat(mix(tokens * np.uint64(salt) + np.uint64(i)), starts[full])
                sig = sig.view(np.int64)
                _, first = np.unique(sig.T, axis=0, return_index=True)
                sent = np.zeros(b - a, bool)
                sent[first] = True
                sent &= sizes > 0
                yield _packed(serial, -1, ids[a:b].tobytes() + sig.tobytes(), sizes.astype(np.int64).tobytes(), np.packbits(sent).tobytes())
                use = sent[row]
                tokens, row = tokens[use], row[use]
                fragment = ((tokens >> np.uint64(48)) % np.uint64(fragments)).astype(np.int64)
                order = np.argsort(fragment, kind="stable")
                tokens, row, fragment = tokens[order], row[order], fragment[order]
                cuts = np.append(np.flatnonzero(np.append(True, fragment[1:] != fragment[:-1])), len(fragment)) if len(fragment) else [0]
                for x, y in zip(cuts[:-1], cuts[1:], strict=True):
                    present, counts = np.unique(row[x:y], return_counts=True)
                    yield _packed(serial, int(fragment[x]), b"", np.stack([present, counts]).astype(np.int32).tobytes(), narrow(tokens[x:y]))
                serial += 1

    return docs.select("doc_id", "text").mapInArrow(run, PACKED)


def _packed(*values) -> pa.RecordBatch:
    types = [pa.int64(), pa.int32(), *[pa.binary()] * 3]
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types, strict=True)], names=[x.split(" ")[0] for x in PACKED.split(", ")])


def count_fragment(table: pa.Table) -> pa.Table:
    """Keeps the tokens of a fragment that several sets hold, with the number of sets; block rows pass through."""
    t = table.combine_chunks()
    fragment = t["fragment"].to_numpy()
    head, sizes, tokens = (t[c].to_pylist() for c in ("head", "sizes", "tokens"))
    mine = np.flatnonzero(fragment >= 0).tolist()
    if mine:
        parts = [widen(tokens[i]) for i in mine]
        whole = np.concatenate(parts) | (np.repeat(fragment[mine].astype(np.uint64), [len(p) for p in parts]) << np.uint64(48))
        order = np.argsort(whole, kind="stable")
        fresh = np.ones(len(whole), bool)
        fresh[1:] = whole[order][1:] != whole[order][:-1]
        heads = np.flatnonzero(fresh)
        held = np.empty(len(whole), np.int32)
        held[order] = np.repeat(np.diff(np.append(heads, len(whole))), np.diff(np.append(heads, len(whole))))
        at = 0
        for i, part in zip(mine, parts, strict=True):
            present, counts = np.frombuffer(sizes[i], np.int32).reshape(2, -1)
            own = held[at:at + len(part)]
            keep = own > 1
            row = np.repeat(present, counts)[keep]
            head[i] = own[keep].tobytes()
            sizes[i] = row.astype(np.int32).tobytes()
            tokens[i] = whole[at:at + len(part)][keep].tobytes()
            at += len(part)
    return pa.table({"block": t["block"], "fragment": t["fragment"], "head": pa.array(head, pa.binary()), "sizes": pa.array(sizes, pa.binary()), "tokens": pa.array(tokens, pa.binary())})


def spare(n: np.ndarray) -> np.ndarray:
    """How many shingles of a set of n a partner may lack: n minus the least overlap."""
    return n - (NEEDED * n + PARTS - 1) // PARTS


def parity_sketches(row: np.ndarray, token: np.ndarray, n_rows: int) -> np.ndarray:
    """SKETCH words for each row (rows in order): a bit is set if an odd number of the row's tokens fall on it."""
    bits = 64 * SKETCH
    out = np.empty((n_rows, SKETCH), np.int64)
    for a in range(0, n_rows, SKETCH_ROWS):
        b = min(a + SKETCH_ROWS, n_rows)
        x, y = np.searchsorted(row, [a, b])
        place = (row[x:y] - a).astype(np.int64) * bits + (token[x:y] % bits)
        odd = np.bincount(place, minlength=(b - a) * bits) & 1
        out[a:b] = np.packbits(odd.astype(np.uint8).reshape(b - a, bits), axis=1).view(np.int64)
    return out


def assemble(table: pa.Table) -> pa.Table:
    """Rows of one block's documents: sizes, signatures, and the shared tokens of sets that can have a partner."""
    t = table.combine_chunks()
    fragment = t["fragment"].to_numpy()
    top = int(np.flatnonzero(fragment == -1)[0])
    head = np.frombuffer(t["head"][top].as_py(), np.int64)
    n_rows = len(head) // 3
    sizes = np.frombuffer(t["sizes"][top].as_py(), np.int64)
    sent = np.unpackbits(np.frombuffer(t["tokens"][top].as_py(), np.uint8))[:n_rows].astype(bool)
    mine = [i for i in np.flatnonzero(fragment >= 0).tolist()]
    row = np.concatenate([np.frombuffer(t["sizes"][i].as_py(), np.int32) for i in mine] or [np.empty(0, np.int32)])
    held = np.concatenate([np.frombuffer(t["head"][i].as_py(), np.int32) for i in mine] or [np.empty(0, np.int32)])
    token = np.concatenate([np.frombuffer(t["tokens"][i].as_py(), np.uint64) for i in mine] or [np.empty(0, np.uint64)])
    order = np.lexsort((token, held, row))
    row, token = row[order], token[order].view(np.int64)
    shared = np.bincount(row, minlength=n_rows)
    ends = np.cumsum(shared)
    alone = np.where(sent, sizes - shared, 0)
    linked = sent & (alone <= spare(sizes)) & (shared > 0)
    lists = [token[ends[i] - shared[i]:ends[i]] if linked[i] else None for i in range(n_rows)]
    fragments = len(CUTS) + 1
    per_fragment = np.bincount(row * fragments + np.searchsorted(CUTS, held[order]), minlength=n_rows * fragments)
    fragment_ends = np.cumsum(per_fragment.reshape(n_rows, fragments), axis=1).tolist()
    kept = linked[row]
    sketches = parity_sketches((np.cumsum(linked) - 1)[row[kept]], token[kept], int(linked.sum()))
    sketch = iter(sketches)
    return pa.table({
        "doc_id": pa.array(head[:n_rows], pa.int64()), "sig_a": pa.array(head[n_rows:2 * n_rows], pa.int64()), "sig_b": pa.array(head[2 * n_rows:], pa.int64()),
        "n_shingles": pa.array(sizes, pa.int64()), "alone": pa.array(alone, pa.int64()), "tokens": pa.array(lists, pa.list_(pa.int64())),
        "ends": pa.array([fragment_ends[i] if linked[i] else None for i in range(n_rows)], pa.list_(pa.int32())),
        "sketch": pa.array([next(sketch) if yes else None for yes in linked.tolist()], pa.list_(pa.int64())),
    })


def shingle_sets(docs: DataFrame, k: int = 5) -> DataFrame:
    """SETS of documents: one row each; tokens (rare first) only for one of a block's equal sets, if it may have partners."""
    fragments = 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = pack(docs, fragments, k)
    place = F.when(F.col("fragment") >= 0, F.col("fragment")).otherwise(F.pmod(F.col("block"), F.lit(fragments)).cast("int"))
    counted = blocks.groupBy(place.alias("place")).applyInArrow(count_fragment, PACKED)
    return counted.groupBy("block").applyInArrow(assemble, SETS)


def least_overlap(x: Column, y: Column) -> Column:
    """The least intersection of sets of x and y shingles that links them."""
    return F.ceil((x + y) * NEEDED / (PARTS + NEEDED))


def may_link(n: Column, alone: Column, at: Column, m: Column, other_alone: Column, other_at: Column) -> Column:
    """Whether sets of n and m shingles that share the ones at these places of the order can reach the overlap."""
    reach = F.least(at - alone, other_at - other_alone) + 1 + F.least(n - at - 1, m - other_at - 1)
    return (F.least(n, m) * PARTS >= F.greatest(n, m) * NEEDED) & (reach >= least_overlap(n, m))


def close_enough(n: Column, alone: Column, sketch: Column, m: Column, other_alone: Column, other: Column) -> Column:
    """Whether sets may differ in few enough shingles to link.

    A shingle that only one of two sets holds turns one bit, so the sketches never differ in more bits than the sets
    do in shared shingles: no pair that links is refused.
    """
    bits = reduce(Column.__add__, [F.bit_count(F.get(sketch, F.lit(i)).bitwiseXOR(F.get(other, F.lit(i)))) for i in range(SKETCH)])
    return alone + other_alone + bits <= n + m - 2 * least_overlap(n, m)


def pieces(sets: DataFrame) -> DataFrame:
    """Token lists cut into the consecutive fragments of the order, each in its own row: node, piece, part."""
    def part(end: Column, i: Column) -> Column:
        start = F.coalesce(F.get("ends", i - 1), F.lit(0))
        return F.slice("tokens", start + 1, end - start)

    return sets.select("node", F.posexplode(F.transform("ends", part)).alias("piece", "part")).where(F.size("part") > 0)


def verified(pairs: DataFrame, parts: DataFrame) -> DataFrame:
    """Those of the pairs (node, h_node, n, h_n) that link: overlaps counted by fragment, summed per pair."""
    left = pairs.join(parts, "node").select("node", "h_node", "n", "h_n", F.struct(F.col("h_node").alias("node"), "piece").alias("key"), F.col("part").alias("left"))
    # only hubs' parts travel, as long as the list of hubs is short enough to be sent to them
    hubs = pairs.select(F.col("h_node").alias("node")).distinct()
    hub_parts = parts.join(hubs.hint("broadcast"), "node", "left_semi") if fits_broadcast(pairs.sparkSession, hubs.count(), 16) else parts
    # a hub meets all holders of its shingles: its parts are copied to salts
    both = salted_lookup(left, hub_parts.select(F.struct("node", "piece").alias("key"), "part"), "key", "node")
    summed = both.groupBy("node", "h_node", "n", "h_n").agg(F.sum(F.size(F.array_intersect("left", "part"))).alias("same"))
    union = F.col("n") + F.col("h_n") - F.col("same")
    return summed.where(F.col("same") * PARTS >= union * NEEDED).select(F.col("node").alias("x"), F.col("h_node").alias("y"))


def relabel(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Smallest node reachable, for all nodes of `labels` (node, label), after adding links (x, y)."""
    # links between the groups so far, few; groups point at the least neighbour until nothing moves
    left = links.join(labels.select(F.col("node").alias("x"), F.col("label").alias("a")), "x")
    between = salted_lookup(left, labels.select(F.col("node").alias("y"), F.col("label").alias("b")), "y", "x").where(F.col("a") != F.col("b"))
    edges = cut(between.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.*").distinct(), "edges")
    groups = cut(edges.select(F.col("a").alias("node"), F.col("a").alias("label")).distinct(), "groups")
    while True:
        key = groups.select(F.col("node").alias("b"), "label")
        pulled = salted_lookup(edges, key, "b", "a").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("pulled"))
        lower = groups.join(pulled, "node").select("node", "label", F.least("label", "pulled").alias("low"))
        jump = groups.select(F.col("node").alias("low"), F.col("label").alias("far"))
        moved = cut(salted_lookup(lower, jump, "low", "node").select("node", F.least("low", "far").alias("label"), (F.least("low", "far") != F.col("label")).alias("moved")), "groups")
        still = moved.where("moved").limit(1).count() == 0
        discard(groups)
        groups = moved.drop("moved")
        groups._cut_path = moved._cut_path
        if still:
            break
    final = groups.select(F.col("node").alias("label"), F.col("label").alias("low"))
    found = cut(labels.join(final, "label", "left").select("node", F.coalesce("low", "label").alias("label")), "labels")
    discard(edges, groups)
    return found


def in_buckets(holders: DataFrame) -> DataFrame:
    """Holders of a shingle dealt into buckets of about BUCKET, a copy for each bucket that is met: (low, high).

    Two holders meet at the numbers of their buckets, so a shingle that very many hold is compared in many tasks.
    """
    buckets = F.ceil(F.col("all") / BUCKET)
    dealt = holders.withColumn("bucket", F.pmod(F.xxhash64("node"), buckets))
    copies = dealt.withColumn("_met", F.explode(F.sequence(F.lit(0).cast("bigint"), F.ceil(F.col("all") / BUCKET) - 1)))
    return copies.withColumns({"low": F.least("bucket", "_met"), "high": F.greatest("bucket", "_met")}).drop("_met", "all")


def components(sets: DataFrame) -> DataFrame:
    """(node, label): the smallest node that links reach, for sets (node, n_shingles, alone, tokens, sketch).

    A shingle's holders are first compared with one hub each round, the hub being the holder with the fewest shingles
    of its own; holders that now share a group need no comparison. When few pairs of different groups are left, or
    after HUB_ROUNDS, all of these are compared, so no link between groups is missed; pairs whose parity sketches
    prove that they differ too much are not sent.
    """
    n = F.col("n_shingles")
    places = F.transform("tokens", lambda t, i: F.struct(t.alias("token"), (i + F.col("alone")).alias("at")))
    prefix = F.filter(places, lambda p: p["at"] <= n - F.ceil(n * NEEDED / PARTS))
    entries = sets.select("node", n.alias("n"), "alone", F.explode(prefix).alias("p")).select("p.token", "node", "n", "alone", "p.at")
    # shingles with the same holders bring the same pairs: one of them stands for all
    holders = [F.bit_xor(F.xxhash64("node", F.lit(i))) for i in range(2)]
    kinds = entries.groupBy("token").agg(F.count("*").alias("c"), *[h.alias(f"s{i}") for i, h in enumerate(holders)]).where("c > 1")
    chosen = kinds.groupBy("c", "s0", "s1").agg(F.min("token").alias("token")).select("token")
    entries = cut(salted_lookup(entries, chosen, "token", "node"), "entries")
    parts = cut(pieces(sets.join(entries.select("node").distinct(), "node", "left_semi")), "parts")
    old: list[DataFrame] = []
    labels = cut(sets.select("node", F.col("node").alias("label")), "labels")
    tried = None
    for turn in range(HUB_ROUNDS + 1):
        marked = cut(entries.join(labels, "node"), "marked")
        spread = marked.groupBy("token", "label").agg(F.count("*").alias("c")).groupBy("token").agg(
            F.count("*").alias("groups"), F.sum("c").alias("all"), F.sum(F.col("c") * F.col("c")).alias("inside")).where("groups > 1")
        open_ = cut(spread.select("token", ((F.col("all") * F.col("all") - F.col("inside")) / 2).alias("pairs"), "all"), "open")
        left, rows = open_.agg(F.coalesce(F.sum("pairs"), F.lit(0.0)), F.coalesce(F.sum("all"), F.lit(0))).first()
        if not left:
            discard(marked, open_)
            break
        last = left <= FEW * rows or turn == HUB_ROUNDS
        # groups only grow, so a shingle whose holders are in one group is done with for good
        waiting = cut(salted_lookup(marked, open_.select("token", "all"), "token", "node"), "waiting")
        discard(marked, open_, entries)
        entries = waiting.drop("label", "all")
        entries._cut_path = waiting._cut_path
        fields = ("node", "n", "alone", "at", "label")
        if last:
            sketched = in_buckets(waiting.join(sets.select("node", "sketch"), "node"))
            other = sketched.select("token", "low", "high", *[F.col(c).alias(f"h_{c}") for c in (*fields, "sketch", "bucket")])
            fit = close_enough(*[F.col(c) for c in ("n", "alone", "sketch", "h_n", "h_alone", "h_sketch")])
            once = (F.col("bucket") == F.col("h_bucket")) == (F.col("low") == F.col("high"))
            met = sketched.join(other, ["token", "low", "high"]).where((F.col("node") < F.col("h_node")) & once & fit)
        else:
            first = F.struct(*([F.col("alone") / F.col("n")] if turn == 0 else [F.xxhash64("node", F.lit(turn))]), *fields)
            hubs = waiting.groupBy("token").agg(F.min(first).alias("h")).select("token", *[F.col(f"h.{c}").alias(f"h_{c}") for c in fields])
            met = salted_lookup(waiting, hubs, "token", "node")
        close = met.where((F.col("label") != F.col("h_label")) & may_link(*[F.col(c) for c in ("n", "alone", "at", "h_n", "h_alone", "h_at")]))
        pairs = close.select("node", "h_node", "n", "h_n").distinct()
        if tried is not None:
            pairs = pairs.join(tried, ["node", "h_node"], "left_anti")
        pairs = cut(pairs, "pairs")
        old.append(pairs)
        seen = pairs.select("node", "h_node").union(pairs.select(F.col("h_node"), F.col("node")))
        tried = seen if tried is None else tried.union(seen)
        links = cut(verified(pairs, parts), "links")
        if links.limit(1).count():
            before, labels = labels, relabel(labels, links)
            discard(before)
        discard(links)
        if last:
            break
    discard(entries, parts, *old)
    return labels


def jaccard_components(docs: DataFrame, k: int = 5) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_shingles, component_id.

    A-Z are lower-cased, words are runs of bytes other than space and 9 to 13; a set holds the distinct k-word shingles
    of the whole text, or the whole sequence if there are fewer words; null, empty and blank texts have none and link
    with nothing. component_id is the smallest doc_id that links reach. Rows with equal sets are one class and are not
    compared; rows that repeat an id share its component; a row without an id has none (null) and links nothing.
    An empty table gives none. Shingles are 64-bit hashes of which 48 and the fragment's number are kept, classes 128-bit signatures.
    """
    sets = cut(shingle_sets(docs.where(F.col("doc_id").isNotNull()), k), "sets")
    signature = F.struct("sig_a", "sig_b", "n_shingles")
    full = sets.where("n_shingles > 0")
    classes = cut(full.groupBy(signature.alias("sig")).agg(F.min("doc_id").alias("node")), "classes")
    candidates = full.where("tokens IS NOT NULL").groupBy(signature.alias("sig")).agg(*[F.first(c).alias(c) for c in ("alone", "tokens", "ends", "sketch")])
    nodes = cut(candidates.join(classes, "sig").select("node", F.col("sig.n_shingles").alias("n_shingles"), "alone", "tokens", "ends", "sketch"), "nodes")
    labels = components(nodes)
    discard(nodes)
    named = classes.join(labels, "node", "left").select("sig", F.coalesce("label", "node").alias("label"))
    joined = salted_lookup(full.select("doc_id", "n_shingles", signature.alias("sig")), named, "sig", "doc_id")
    linked = joined.select("doc_id", "n_shingles", F.col("label").alias("component_id"))
    single = sets.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    nameless = docs.where(F.col("doc_id").isNull()).select(F.col("doc_id").cast("bigint"), F.lit(None).cast("bigint").alias("n_shingles"), F.lit(None).cast("bigint").alias("component_id"))
    return linked.union(single).union(nameless)
