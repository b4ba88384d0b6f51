"""Benchmark decontamination with SimHash windows and a multi-index over Hamming blocks, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut

SHINGLE = 5
SIMILARITY = 0.8
#: Bits of a fingerprint (two words) that may differ. Sets of weighted similarity 0.8 differ in 19.4 bits on average
#: with a deviation of 4.1, so 31 lies 2.9 deviations above the worst case that counts.
RADIUS = 31
#: RADIUS + 1 blocks of 4 bits: fingerprints within the radius agree in one block at least.
BLOCK_BITS = 4
#: The benchmark's shingles are broadcast up to this many bytes, counted first; beyond it they are joined by shuffle.
BROADCAST_BYTES = 64 << 20


def with_shingles(rows: DataFrame, out: str = "sh") -> DataFrame:
    """Replaces `text` by hashes of its five-word shingles in text order, words lower-cased, and their number `n`.

    1 to 4 words are one shingle, none is empty. Words are hashed first, in a column of their own: inside a
    lambda they would be split, or copied, anew for every shingle.
    """
    words = F.array_remove(F.split(F.lower(F.coalesce("text", F.lit(""))), r"[\x20\x09-\x0D]+"), "")
    split = rows.withColumn("_words", F.transform(words, lambda w: F.xxhash64(w))).drop("text").withColumn("n", F.size("_words"))
    # five words from two times two and one: three passes with a short lambda; past the end the words are null, which hash as nothing
    shifted = lambda c, by: F.slice(F.col(c), F.lit(by + 1), F.greatest(F.col("n") - by, F.lit(0)))
    join = lambda a, b: F.xxhash64(a, b)
    pairs = split.withColumn("_two", F.zip_with("_words", shifted("_words", 1), join))
    fours = pairs.withColumn("_four", F.zip_with("_two", shifted("_two", 2), join)).drop("_two")
    count = F.when(F.col("n") > 0, F.greatest(F.col("n") - (SHINGLE - 1), F.lit(1))).otherwise(0)
    found = fours.withColumn(out, F.slice(F.zip_with("_four", shifted("_words", SHINGLE - 1), join), F.lit(1), count)).drop("_words", "_four")
    return found.withColumn("n", count)


def with_prints(rows: DataFrame) -> DataFrame:
    """Adds `print` and `set` to rows of shingles `sh`.

    print: two 64-bit words; a bit is set if most shingles, each counted as often as it occurs, have it in their hash.
    set: the multiset as a set, equal shingles told apart by their count so far.
    """
    word = (
        "aggregate(transform(sequence(0, 63), b -> IF(2 * aggregate({s}, 0, (n, x) -> n + CAST(shiftright(x, b) & 1 AS INT)) > size({s}),"
        " shiftleft(1L, b), 0L)), 0L, (a, x) -> a | x)")
    prepared = rows.withColumns({"_again": F.expr("transform(sh, y -> xxhash64(y, 1))"), "_sorted": F.array_sort("sh")})
    return prepared.withColumns({
        "print": F.array(F.expr(word.format(s="sh")), F.expr(word.format(s="_again"))),
        "set": F.expr("transform(_sorted, (x, i) -> xxhash64(x, i - array_position(_sorted, x)))"),
    }).drop("_again", "_sorted")


def block_keys(prints: Column) -> Column:
    """(number, bits) of each block of a fingerprint."""
    per_word = 64 // BLOCK_BITS
    mask = (1 << BLOCK_BITS) - 1
    return F.array(*[
        F.struct(F.lit(i).alias("number"), F.shiftrightunsigned(prints[i // per_word], (i % per_word) * BLOCK_BITS).bitwiseAND(F.lit(mask)).cast("int").alias("bits"))
        for i in range(2 * per_word)
    ])


def join_small(rows: DataFrame, small: DataFrame, on: list[str], n_rows: int, row_bytes: int) -> DataFrame:
    return rows.join(small.hint("broadcast" if n_rows * row_bytes <= BROADCAST_BYTES else "merge"), on)


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Best match of each benchmark item in each document: doc_id, item_id, start (shingle), hamming, similarity >= 0.8.

    Windows have as many shingles as an item (a shorter document is one window), at every start. A window counts only if
    it holds so many of the items' shingles that the similarity can be reached; all these are fingerprinted. All pairs
    of window and item of one size within RADIUS bits are found by their blocks, then verified by sum(min) / sum(max)
    of the shingle counts. Ties go to a start where a shared shingle lies as in an item, then to the smaller start. Null and empty texts and items match
    nothing; repeated rows match once; rows without an id are not reported; other columns are not read.
    """
    given = with_shingles(benchmark.where(F.col("item_id").isNotNull()).select("item_id", "text"))
    items = cut(given.select("item_id", "sh", F.col("n").alias("size")), "items").where(F.col("size") > 0).dropDuplicates()
    n_items, n_shingles = items.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    parts = items.select("size", F.posexplode("sh").alias("at", "h")).distinct()
    named = docs.where(F.col("doc_id").isNotNull()).select("doc_id", "text")
    # the outer form of explode: the other one infers a filter that would compute the shingles inside a predicate, twice
    spread = with_shingles(named).select("doc_id", "n", F.posexplode_outer("sh").alias("pos", "h"))
    hits = join_small(spread, parts, ["h"], n_shingles, 40)
    start = F.greatest(F.lit(0), F.least(F.col("pos") - F.col("at"), F.col("n") - F.col("size")))
    places = hits.groupBy("doc_id", "size").agg(
        F.max("n").alias("n"), F.array_sort(F.collect_set("pos")).alias("places"), F.collect_set(start).alias("laid"))
    # with fewer shared places than this in a window, sum(min) / sum(max) stays below the similarity
    need = F.ceil(SIMILARITY / (1 + SIMILARITY) * (F.least("n", "size") + F.col("size")) - 1e-9).cast("int")
    dense = places.withColumn("need", need).where(F.size("places") >= F.col("need"))
    # the starts of windows whose first shared place is the i-th, as far as they reach the last one needed
    low, high = "greatest(0, places[i + need - 1] - size + 1, IF(i > 0, places[i - 1] + 1, 0))", "least(places[i], greatest(0, n - size))"
    starts = F.expr(f"flatten(transform(sequence(0, size(places) - need), i -> IF({low} <= {high}, sequence({low}, {high}), CAST(array() AS ARRAY<INT>))))")
    spans = dense.select("doc_id", "size", "laid", starts.alias("starts"))
    one = F.transform("starts", lambda s: F.struct(s.alias("start"), F.col("size"), F.array_contains("laid", s).alias("laid")))
    laid = spans.where(F.size("starts") > 0).groupBy("doc_id").agg(F.flatten(F.collect_list(one)).alias("windows"))
    # texts are read once more for the few documents with a window
    held = cut(with_shingles(named.join(laid, "doc_id"), "doc_sh").drop("n"), "windows")
    windows = held.select("doc_id", "doc_sh", F.explode("windows").alias("w")).select(
        "doc_id", "w.start", "w.size", "w.laid", F.slice("doc_sh", F.col("w.start") + 1, F.col("w.size")).alias("sh")).where(F.size("sh") > 0)
    asked = with_prints(windows).select("doc_id", "start", "size", "laid", F.explode_outer(block_keys(F.col("print"))).alias("b"), "print", "set")
    known = with_prints(items).select("item_id", "size", F.explode_outer(block_keys(F.col("print"))).alias("b"), F.col("print").alias("item_print"), F.col("set").alias("item_set"))
    met = join_small(asked, known, ["size", "b"], (n_items * 64 + n_shingles * 8) * 32, 1)
    apart = F.bit_count(F.col("print")[0].bitwiseXOR(F.col("item_print")[0])) + F.bit_count(F.col("print")[1].bitwiseXOR(F.col("item_print")[1]))
    near = met.withColumn("hamming", apart).where(F.col("hamming") <= RADIUS)
    same = F.size(F.array_intersect("set", "item_set"))
    similarity = same / (F.size("set") + F.size("item_set") - same)
    found = near.withColumn("similarity", similarity).where(F.col("similarity") >= SIMILARITY)
    best = found.groupBy("doc_id", "item_id").agg(F.max(F.struct("similarity", "laid", (-F.col("start")).alias("back"), "hamming")).alias("best"))
    return best.select("doc_id", "item_id", (-F.col("best.back")).cast("int").alias("start"), F.col("best.hamming").cast("int").alias("hamming"), "best.similarity")


SQL = r"""
WITH dw AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents WHERE doc_id IS NOT NULL),
iw AS (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM benchmark WHERE item_id IS NOT NULL),
dx AS (SELECT doc_id, len(w) AS n, unnest(w) AS x, generate_subscripts(w, 1) - 1 AS pos FROM dw),
ix AS (SELECT item_id, len(w) AS n, unnest(w) AS x, generate_subscripts(w, 1) - 1 AS spot FROM iw),
de AS (SELECT doc_id, greatest(n - 4, 1) AS n, pos, concat_ws(' ', x, lead(x, 1) OVER o, lead(x, 2) OVER o, lead(x, 3) OVER o, lead(x, 4) OVER o) AS h
  FROM dx WINDOW o AS (PARTITION BY doc_id ORDER BY pos) QUALIFY pos < greatest(n - 4, 1)),
ie AS (SELECT item_id, greatest(n - 4, 1) AS size, spot, concat_ws(' ', x, lead(x, 1) OVER o, lead(x, 2) OVER o, lead(x, 3) OVER o, lead(x, 4) OVER o) AS h
  FROM ix WINDOW o AS (PARTITION BY item_id ORDER BY spot) QUALIFY spot < greatest(n - 4, 1)),
wn AS (SELECT DISTINCT doc_id, greatest(0, least(pos - spot, n - size)) AS start, size FROM de JOIN ie USING (h)),
wc AS (SELECT doc_id, start, size, h, count(*) AS c FROM wn JOIN de USING (doc_id) WHERE pos >= start AND pos < start + size GROUP BY ALL),
ic AS (SELECT item_id, size, h, count(*) AS c FROM ie GROUP BY ALL),
sums AS (SELECT doc_id, item_id, start, size, sum(least(wc.c, ic.c)) AS same FROM wc JOIN ic USING (size, h) GROUP BY ALL),
sizes AS (SELECT doc_id, start, size, sum(c) AS n FROM wc GROUP BY ALL),
s AS (SELECT doc_id, item_id, start, same / (n + size - same) AS similarity FROM sums JOIN sizes USING (doc_id, start, size))
"""
