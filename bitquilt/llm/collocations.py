"""Phrase collocations: Apriori levels counted with broadcast double-array tries.

Texts become blocks of word ids once; a word that is too rare, a mark between pieces and the end of a text are -1, which no phrase
contains. Level k starts from the frequent phrases of k - 1 words, in a trie that numpy walks from all text positions at once:
a phrase of k words can only be frequent if it is frequent without its last and without its first word. The safe phrases that
the shards hold often enough together are the candidates, so a trie is never filled with phrases seen once; a second trie holds
them, accepting places are counted by bincount in each task, and the counts of the tasks are summed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.rank import global_rank
from ..session import cut, discard
from .common import salted_lookup
from .double_array import DoubleArray
from .text import byte_rows, spans_of

#: Marks between pieces, and what separates words inside them.
MARKS, BLANKS = ".,;:!?\n\x0b\x0c\r", " \t"
WORD = r"[^\x20\x09.,;:!?\x0A-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Phrases of a trie and words of a dictionary that are broadcast at once; more are worked off block by block.
BLOCK = 1 << 18
#: Phrases of a counter vector, and tasks whose vectors are added at once.
CHUNK, MERGED = 1 << 12, 64
#: Phrases that a task holds before it hands their counts on.
HELD = 1 << 22


def _tables() -> bytes:
    table = bytearray(range(256))
    for a, b in zip(UPPER, LOWER, strict=True):
        table[ord(a)] = ord(b)
    for mark in MARKS:
        table[ord(mark)] = ord(".")
    return bytes(table)


PLAIN = _tables()


def tokens_of(text: bytes) -> list[bytes]:
    """The lower-cased words of a text with a single full stop, which is no word, for each mark."""
    return text.translate(PLAIN).replace(b".", b" . ").split()


def word_table(docs: DataFrame) -> DataFrame:
    """lang, word, f: occurrences of each word; a null lang is `und`, a null text empty."""
    text = F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER)
    words = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.explode(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))).alias("word"))
    return words.groupBy("lang", "word").agg(F.count("*").alias("f"))


class Ids(dict):
    def __missing__(self, word: bytes) -> int:
        return -1


def fill_ids(rows: DataFrame, dictionary, last: bool) -> DataFrame:
    """The ids (32-bit) found so far and those of the words in the broadcast (lang, word, id) columns: by row, with lang and text.

    The last dictionary leaves the ids alone: texts end to end with a -1 between them, a row for about CHUNK_BYTES of text or one text.
    """

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, Ids] = {}
        for lang, word, i in zip(*dictionary.value, strict=True):
            known.setdefault(lang, Ids())[word.encode()] = i
        empty, gap = Ids(), np.array([-1], np.int32).tobytes()
        for batch in batches:
            data, starts, ends = byte_rows(batch.column(1))
            langs, before = batch.column(0).to_pylist(), byte_rows(batch.column(2))
            for a, b in spans_of(ends - starts):
                out = []
                for row in range(a, b):
                    ids = np.array(list(map(known.get(langs[row], empty).__getitem__, tokens_of(data[starts[row]:ends[row]].tobytes()))), np.int32)
                    if before[2][row] > before[1][row]:
                        ids = np.maximum(ids, before[0][before[1][row]:before[2][row]].view(np.int32))
                    out.append(ids.tobytes())
                if last:
                    yield pa.RecordBatch.from_arrays([pa.array([gap.join(out)], pa.binary())], names=["ids"])
                else:
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(out, pa.binary())], names=["lang", "text", "ids"])

    return rows.mapInArrow(fill, "ids binary" if last else "lang string, text string, ids binary")


def encode_texts(docs: DataFrame, words: DataFrame, n_words: int, block: int = BLOCK) -> DataFrame:
    """The stored blocks of ids of all texts. `words` has lang, word, id (dense from 0); a dictionary block is broadcast at once."""
    rows = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"), F.lit(None).cast("binary").alias("ids"))
    context, last = docs.sparkSession.sparkContext, None
    starts = list(range(0, max(n_words, 1), block))
    for start in starts:
        part = words.where((F.col("id") >= start) & (F.col("id") < start + block)).select("lang", "word", "id").toArrow()
        dictionary = context.broadcast(tuple(part.column(i).to_pylist() for i in range(3)))
        rows = cut(fill_ids(rows, dictionary, start == starts[-1]), "word_ids")
        dictionary.unpersist()
        if last is not None:
            discard(last)
        last = rows
    return rows


def id_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    for batch in batches:
        data, starts, ends = byte_rows(batch.column(0))
        for a, b in zip(starts, ends, strict=True):
            yield data[a:b].view(np.int32).astype(np.int64)


def blocks_of(phrases: DataFrame, n: int, block: int = BLOCK) -> Iterator[np.ndarray]:
    """Phrases (w array<int>) as matrices of about `block` rows: one broadcast each."""
    parts = max(1, -(-n // block))
    for part in range(parts):
        chosen = phrases.select("w").where(F.pmod(F.xxhash64("w"), F.lit(parts)) == part) if parts > 1 else phrases.select("w")
        column = chosen.toArrow().column(0).combine_chunks()
        if len(column):
            yield column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def safe_keys(trie: DoubleArray | None, ids: np.ndarray, alone: bool) -> tuple[np.ndarray, np.ndarray]:
    """Positions where a phrase of one more word may be frequent, and its key: number of the phrase without its last word, that word.

    trie None: single words. With one trie alone, the phrase without its first word has to be in it too.
    """
    if trie is None:
        at = np.flatnonzero((ids[:-1] >= 0) & (ids[1:] >= 0))
        return at, ids[at] << 32 | ids[at + 1]
    at, phrase = trie.walk(ids)
    starts = np.zeros(len(ids) + 1, bool)
    starts[at] = True
    inside = at + trie.length < len(ids)
    at, phrase = at[inside], phrase[inside]
    safe = (ids[at + trie.length] >= 0) & (starts[at + 1] | (not alone))
    at, phrase = at[safe], phrase[safe]
    return at, phrase << 32 | ids[at + trie.length]


def safe_counts(encoded: DataFrame, trie, alone: bool) -> DataFrame:
    """key, n: how often each safe phrase of one more word occurs, summed in the task as far as HELD keys go, then over tasks."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def hand_on() -> Iterator[pa.RecordBatch]:
            keys, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            for i in range(0, len(keys), HELD // 8):
                yield pa.RecordBatch.from_arrays([pa.array(keys[i:i + HELD // 8]), pa.array(n[i:i + HELD // 8])], names=["key", "n"])

        for ids in id_rows(batches):
            held.append(safe_keys(trie and trie.value, ids, alone)[1])
            if sum(map(len, held)) > HELD:
                yield from hand_on()
        if held:
            yield from hand_on()

    return encoded.mapInArrow(count, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n"))


def named(keys: DataFrame, trie) -> DataFrame:
    """w: the phrases of the keys."""

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = np.asarray(batch.column(0), np.int64)
            first = (k >> 32)[:, None] if trie is None else trie.value.phrases[k >> 32]
            w = np.concatenate([first, (k & 0xFFFFFFFF)[:, None]], axis=1).astype(np.int32)
            offsets = pa.array(np.arange(len(w) + 1) * w.shape[1], pa.int32())
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(offsets, pa.array(w.reshape(-1)))], names=["w"])

    return keys.select("key").mapInArrow(name, "w array<int>")


def add_vectors(rows: pa.Table) -> pa.Table:
    """One row for the chunk: its tasks' counters added up."""
    total = sum(np.frombuffer(x, np.int64) for x in rows.column("counts").to_pylist())
    return pa.table({"chunk": rows.column("chunk").slice(0, 1), "part": pa.array([0], pa.int32()), "counts": pa.array([total.tobytes()], pa.binary())})


def phrase_counts(encoded: DataFrame, trie, least: int) -> DataFrame:
    """w, a: the trie's phrases that occur at least `least` times.

    A task counts by bincount over the accepting places and hands its counters on as vectors of CHUNK phrases; vectors of some tasks
    (MERGED at once) and then those sums are added, so neither step holds more than some vectors of a chunk.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        found = trie.value
        total = np.zeros(-(-len(found.phrases) // CHUNK) * CHUNK, np.int64)
        for ids in id_rows(batches):
            total += np.bincount(found.walk(ids)[1], minlength=len(total))
        vectors = total.reshape(-1, CHUNK)
        used = np.flatnonzero(vectors.any(axis=1))
        part = TaskContext.get().partitionId() // MERGED
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(np.full(len(used), part), pa.int32()), pa.array([vectors[i].tobytes() for i in used], pa.binary())], names=["chunk", "part", "counts"])

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = trie.value.phrases
        for batch in batches:
            for chunk, counts in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                total = np.frombuffer(counts, np.int64)
                at = np.flatnonzero(total >= least)
                w = phrases[chunk * CHUNK + at].astype(np.int32)
                offsets = pa.array(np.arange(len(w) + 1) * phrases.shape[1], pa.int32())
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(offsets, pa.array(w.reshape(-1))), pa.array(total[at])], names=["w", "a"])

    kind = "chunk int, part int, counts binary"
    summed = encoded.mapInArrow(count, kind).groupBy("chunk", "part").applyInArrow(add_vectors, kind)
    return summed.groupBy("chunk").applyInArrow(add_vectors, kind).mapInArrow(name, "w array<int>, a bigint")


def next_level(encoded: DataFrame, shorter: DataFrame | None, n_shorter: int, n_words: int, least: int, block: int = BLOCK) -> DataFrame:
    """w, a: the phrases of one more word than `shorter` (None: of two words) that occur at least `least` times; stored."""
    context = encoded.sparkSession.sparkContext
    alone = n_shorter <= block
    tries = [None] if shorter is None else [context.broadcast(DoubleArray(w, n_words)) for w in blocks_of(shorter, n_shorter, block)]
    # one job per trie, so that a task holds one at a time
    parts = [cut(named(safe_counts(encoded, trie, alone).where(F.col("n") >= least), trie), "candidates") for trie in tries]
    candidates = parts[0]
    for other in parts[1:]:
        candidates = candidates.unionAll(other)
    found = []
    for w in blocks_of(candidates, candidates.count(), block):
        trie = context.broadcast(DoubleArray(w, n_words))
        found.append(cut(phrase_counts(encoded, trie, least), "phrases"))
        trie.unpersist()
    for trie in tries:
        if trie is not None:
            trie.unpersist()
    discard(*parts)
    if not found:
        return cut(encoded.sparkSession.createDataFrame([], "w array<int>, a bigint"), "phrases")
    out = found[0]
    for other in found[1:]:
        out = out.unionAll(other)
    return out


def frequent_phrases(docs: DataFrame, least: int, longest: int, block: int = BLOCK) -> tuple[DataFrame, list[DataFrame]]:
    """The words (id, lang, word, f, n) that occur at least `least` times, and the phrases (w, a) of 2, 3, ... words that do."""
    counted = cut(word_table(docs), "words")
    totals = counted.groupBy("lang").agg(F.sum("f").alias("n"))
    often = salted_lookup(counted.where(F.col("f") >= least), totals, "lang", "word")
    words = cut(global_rank(often, [F.col("lang"), F.col("word")], "id"), "frequent_words")
    n_words = words.count()
    levels: list[DataFrame] = []
    if n_words:
        encoded = encode_texts(docs, words, n_words, block)
        shorter, n_shorter = None, 0
        for _ in range(2, longest + 1):
            shorter = next_level(encoded, shorter, n_shorter, n_words, least, block)
            n_shorter = shorter.count()
            if not n_shorter:
                break
            levels.append(shorter)
        discard(encoded)
    discard(counted)
    return words, levels


def collocations(docs: DataFrame, most: int = 2000, least: int = 100, longest: int = 5, block: int = BLOCK) -> DataFrame:
    """Each lang's first `most` phrases by score: lang, rank, phrase, a, l, r, n, score.

    Texts are lower-cased (A-Z), cut into pieces at MARKS and into words at blanks; a phrase of 2 to `longest` words counts wherever its
    words stand next to each other in a piece, overlaps included. Those that occur a >= `least` times are scored at the
    cut where floor(1000 * a * n / (l * r)) is least (then the earliest cut). A phrase inside a longer one that occurs as often is left out.
    The order is score and a descending, then the phrase by its UTF-8 bytes. A null text is empty, a null lang `und`; no ids are read, so rows that
    repeat count each time; texts of any length are counted whole; an empty table has no rows.
    """
    words, levels = frequent_phrases(docs, least, longest, block)
    spark = docs.sparkSession
    if not levels:
        return spark.createDataFrame([], "lang string, rank bigint, phrase string, a bigint, l bigint, r bigint, n bigint, score bigint")
    known = words.select(F.array(F.col("id").cast("int")).alias("w"), F.col("f").alias("a"))
    phrases = levels[0]
    for level in levels[1:]:
        phrases = phrases.unionAll(level)
    # as tables, so that joins know how small they are
    phrases = cut(phrases, "phrases")
    known = cut(known.unionAll(phrases), "known_phrases")
    # a phrase inside a longer one that occurs as often: the next longer one of that chain is enough to see it
    longer = phrases.where(F.size("w") > 2)
    size = F.size("w")
    inside = longer.select(F.explode(F.array(F.slice("w", F.lit(1), size - 1), F.slice("w", F.lit(2), size - 1))).alias("w"), "a")
    covered = inside.groupBy("w").agg(F.max("a").alias("a"))
    kept = cut(phrases.join(covered, ["w", "a"], "left_anti"), "collocations")
    cuts = kept.select("w", "a", F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    parts = cuts.select("w", "a", "k", F.slice("w", F.lit(1), F.col("k")).alias("left"), F.slice("w", F.col("k") + 1, size - F.col("k")).alias("right"))
    with_l = salted_lookup(parts, known.select(F.col("w").alias("left"), F.col("a").alias("l")), "left", "w")
    with_r = salted_lookup(with_l, known.select(F.col("w").alias("right"), F.col("a").alias("r")), "right", "w")
    first = with_r.withColumn("id", F.col("w")[0].cast("bigint"))
    placed = salted_lookup(first, words.select("id", "lang", "n"), "id", "w")
    whole = {c: F.col(c).cast("decimal(19,0)") for c in ("a", "l", "r", "n")}
    score = F.call_function("div", F.lit(1000).cast("decimal(4,0)") * (whole["a"] * whole["n"]), whole["l"] * whole["r"])
    scored = cut(placed.withColumn("score", score), "scored_cuts")
    least_cut = scored.groupBy("w").agg(F.first("a").alias("a"), F.first("lang").alias("lang"), F.first("n").alias("n"), F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    spelled = salted_lookup(kept.select("w", F.posexplode("w").alias("at", "id")).withColumn("id", F.col("id").cast("bigint")), words.select("id", "word"), "id", "w")
    texts = spelled.groupBy("w").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    rows = least_cut.join(texts, "w").select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score"))
    best = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc())
    ranked = rows.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= most)
    return ranked.select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")


SQL = r"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
rows AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM pieces),
grams AS (SELECT lang, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: ws[i:i + k - 1])) AS w FROM rows, range(1, 6) ks(k) WHERE len(ws) >= k),
f AS (SELECT lang, w, count(*) AS a FROM grams GROUP BY lang, w HAVING count(*) >= 100),
totals AS (SELECT lang, sum(len(ws)) AS n FROM rows GROUP BY lang),
covered AS (SELECT DISTINCT lang, unnest([w[1:len(w) - 1], w[2:len(w)]]) AS w, a FROM f WHERE len(w) > 2),
kept AS (SELECT * FROM f WHERE len(w) > 1 AND NOT EXISTS (SELECT 1 FROM covered c WHERE c.lang = f.lang AND c.w = f.w AND c.a = f.a)),
cuts AS (SELECT lang, w, a, unnest(range(1, len(w))) AS k FROM kept),
scored AS (SELECT c.lang, c.w, c.a, c.k, x.a AS l, y.a AS r, t.n, (1000::HUGEINT * c.a * t.n) // (x.a::HUGEINT * y.a) AS score
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.w = c.w[1:c.k] JOIN f y ON y.lang = c.lang AND y.w = c.w[c.k + 1:len(c.w)] JOIN totals t ON t.lang = c.lang),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, w ORDER BY score, k) = 1),
ranked AS (SELECT lang, array_to_string(w, ' ') AS phrase, a, l, r, n, score FROM best)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score
FROM ranked QUALIFY rank <= 2000
"""
