"""Spelling variants: words of a vocabulary that differ by one code point, found by search schemes in FM-indexes.

If two words differ by one inserted, deleted or replaced code point, one half of each word stands unchanged at the same edge of
the other. The vocabulary is dealt into shards of bounded size twice, in the order of the words and in that of the reversed
words; a word searches those shards of the first kind where words start with its left half, and those of the second kind where words
end in its right half. A shard is a bidirectional FM-index of its words with delimiters: the half is matched exactly from the
middle outwards, then the pattern is extended over the other half with one error.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.rank import global_rank
from ..session import cut, discard
from .common import salted_lookup
from .fm_index import BiIndex, one_error

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Runs of letters in a text whose A-Z are lower-cased.
RUN = "[a-zÀ-ÿ]+"
#: One in so many (document, run) loses a code point; least length and occurrences of a word; how much more often its form occurs.
ODDS, LEAST_LENGTH, LEAST_COUNT, RATIO = 199, 6, 5, 5
#: Words in an index, and about as many patterns that meet it in one task.
SHARD = 1 << 13
#: Patterns searched at once.
TOGETHER = 2048


def altered_runs(docs: DataFrame, odds: int = ODDS, shortest: int = 1) -> DataFrame:
    """word: the runs of letters of all texts, one row per occurrence, some with a code point deleted.

    h = crc32 of `<doc_id>:<run>`; if `odds` divides it, code point h % length goes. A row without a doc_id keeps its runs as they are; a null
    text has none. Runs shorter than `shortest` are left out.
    """
    text = F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER)
    runs = docs.select(F.col("doc_id").cast("string").alias("id"), F.explode(F.regexp_extract_all(text, F.lit(RUN), F.lit(0))).alias("run"))
    length = F.char_length("run")
    hashed = runs.where(length >= shortest).withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")))
    at = (F.col("h") % length).cast("int")
    shorter = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, length))
    return hashed.select(F.when(F.col("h") % odds == 0, shorter).otherwise(F.col("run")).alias("word"))


def vocabulary_of(occurrences: DataFrame, shortest: int = LEAST_LENGTH, least: int = LEAST_COUNT) -> DataFrame:
    """word, n: the words of at least `shortest` code points that occur at least `least` times."""
    counts = occurrences.where(F.char_length("word") >= shortest).groupBy("word").agg(F.count("*").alias("n"))
    return counts.where(F.col("n") >= least)


def half_of(word: str, left: bool) -> str:
    """The half that has to be the same, as a prefix of the word or of the reversed word."""
    half = len(word) // 2
    return word[:half] if left else word[half:][::-1]


def routed(ordered: DataFrame, bounds: list[str], left: bool) -> DataFrame:
    """shard, word: a row per shard where words start with the half of a word. `bounds`: first key of each shard."""

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, shards, chosen = batch.column(0).to_pylist(), [], []
            for i, word in enumerate(words):
                key = half_of(word, left)
                first = max(bisect_left(bounds, key) - 1, 0)
                last = max(bisect_right(bounds, key + "\U0010FFFF") - 1, 0)
                shards += range(first, last + 1)
                chosen += [i] * (last - first + 1)
            yield pa.RecordBatch.from_arrays([pa.array(shards, pa.int32()), batch.column(0).take(pa.array(chosen, pa.int64()))], names=["shard", "word"])

    return ordered.select("word").mapInArrow(route, "shard int, word string")


def search_shard(words: pa.Table, patterns: pa.Table, left: bool) -> pa.Table:
    """word, n_near, best_n, form: for each pattern with near words in this shard their number and the most frequent (ties: smallest)."""
    names, counts = words.column("word").to_pylist(), np.array(words.column("n"))
    asked = patterns.column("word").to_pylist()
    empty = pa.table({"word": pa.array([], pa.string()), "n_near": pa.array([], pa.int64()), "best_n": pa.array([], pa.int64()), "form": pa.array([], pa.string())})
    if not names or not asked:
        return empty
    index = BiIndex(names)
    smallest = np.empty(len(names), np.int64)
    smallest[np.argsort(np.array(names, object), kind="stable")] = np.arange(len(names))
    order = np.lexsort((smallest, -counts))
    better = np.empty(len(names), np.int64)
    better[order] = np.arange(len(names))
    lengths = np.array([len(w) for w in asked])
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for length in np.unique(lengths):
        group = np.flatnonzero(lengths == length)
        for a in range(0, len(group), TOGETHER):
            part = group[a:a + TOGETHER]
            points = np.frombuffer("".join([asked[i] for i in part]).encode("utf-32-le"), np.uint32).reshape(len(part), length)
            half = int(length) // 2
            who, word = one_error(index, index.codes(points), half, left)
            if not left:  # words that start with the left half are found on the other side
                keep = np.array([names[w][:half] != asked[part[q]][:half] for q, w in zip(who.tolist(), word.tolist(), strict=True)], bool)
                who, word = who[keep], word[keep]
            found.append((part[who], word))
    who, word = (np.concatenate(x) for x in zip(*found, strict=True))
    if not len(who):
        return empty
    number = np.bincount(who, minlength=len(asked))
    best = np.full(len(asked), len(names))
    np.minimum.at(best, who, better[word])
    hit = np.flatnonzero(number)
    form = order[best[hit]]
    return pa.table({
        "word": pa.array([asked[i] for i in hit], pa.string()), "n_near": pa.array(number[hit], pa.int64()),
        "best_n": pa.array(counts[form], pa.int64()), "form": pa.array([names[i] for i in form], pa.string()),
    })


def searcher(left: bool) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def search(words: pa.Table, patterns: pa.Table) -> pa.Table:
        return search_shard(words, patterns, left)

    return search


def near_words(vocabulary: DataFrame, shard: int = SHARD) -> DataFrame:
    """word, n_near, best_n, form: the words (of at least two code points) that have near words, how many, and the most frequent of them.

    `vocabulary` has distinct words and n. A task holds one shard and about as many patterns; a shard that more patterns
    ask for, as one of a very frequent half, is copied to several tasks.
    """
    results = []
    for left in (True, False):
        key = F.col("word") if left else F.reverse("word")
        ordered = cut(global_rank(vocabulary.select("word", "n", key.alias("_key")), [F.col("_key")], "_rank").withColumn("shard", F.floor(F.col("_rank") / shard).cast("int")), "ordered_words")
        # one key per shard; the shards are `shard` times fewer than the words
        bounds = [r["b"] for r in ordered.groupBy("shard").agg(F.min("_key").alias("b")).orderBy("shard").collect()]
        asked = cut(routed(ordered, bounds, left), "patterns")
        per_shard = asked.groupBy("shard").agg(F.ceil(F.count("*") / shard).cast("int").alias("parts"))
        spread = asked.join(F.broadcast(per_shard) if len(bounds) <= 1 << 16 else per_shard, "shard").withColumn("part", F.pmod(F.xxhash64("word"), F.col("parts")).cast("int"))
        copies = ordered.join(F.broadcast(per_shard) if len(bounds) <= 1 << 16 else per_shard, "shard").select("shard", "word", "n", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
        groups = copies.groupBy("shard", "part").cogroup(spread.select("shard", "word", "part").groupBy("shard", "part"))

        results.append(cut(groups.applyInArrow(searcher(left), "word string, n_near bigint, best_n bigint, form string"), "near_words"))
        discard(ordered, asked)
    both = results[0].unionAll(results[1])
    best = F.min(F.struct((-F.col("best_n")).alias("n"), "form"))
    return both.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best")).select("word", "n_near", (-F.col("best.n")).alias("best_n"), F.col("best.form").alias("form"))


def roots_of(forms: DataFrame) -> DataFrame:
    """word, root: where the forms (word, form) lead in the end. A form occurs more often than its word, so chains end; each round doubles their steps."""
    reached = cut(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = salted_lookup(reached, reached.select(F.col("word").alias("root"), F.col("root").alias("_next")), "root", "word", "left")
        stepped = cut(further.select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")), "roots")
        discard(reached)
        reached = stepped.select("word", "root")
        reached._cut_path = stepped._cut_path
        if stepped.where("_moved").isEmpty():
            return reached


def spelling_variants(occurrences: DataFrame, shortest: int = LEAST_LENGTH, least: int = LEAST_COUNT, ratio: int = RATIO, shard: int = SHARD) -> DataFrame:
    """word, n, n_near, form, form_n, root for the words of the rows of `occurrences` (word).

    A word's form is its near word of largest n (ties: smallest by code points), if that occurs `ratio` (over 1) times as often at least; root
    follows the forms to the last, and is the word itself if it has none. Null words do not count; equal rows count each; no words: no rows.
    """
    if ratio <= 1 or shortest < 2:
        raise ValueError("ratio has to be over 1 and shortest at least 2")
    vocabulary = cut(vocabulary_of(occurrences, shortest, least), "vocabulary")
    near = near_words(vocabulary, shard)
    found = vocabulary.join(near, "word", "left")
    strong = F.col("best_n") >= ratio * F.col("n")
    told = cut(found.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), F.when(strong, F.col("form")).alias("form"), F.when(strong, F.col("best_n")).alias("form_n"),
    ), "forms")
    roots = roots_of(told.where(F.col("form").isNotNull()))
    return told.join(roots, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


SQL = r"""
WITH RECURSIVE step(i, c) AS (SELECT range, [range] FROM range(256)
  UNION ALL SELECT i, list_append(c, CASE WHEN c[-1] & 1 = 1 THEN xor(c[-1] >> 1, 3988292384) ELSE c[-1] >> 1 END) FROM step WHERE len(c) < 9),
crc AS (SELECT list(c[9] ORDER BY i) AS t FROM step WHERE len(c) = 9),
runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run FROM documents),
counted AS (SELECT doc_id, run, count(*) AS k FROM runs WHERE length(run) >= 6 GROUP BY ALL),
hashed AS (SELECT run, k, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(regexp_replace(hex(encode(doc_id || ':' || run)), '(..)', '\1 ', 'g')[1:-2], ' '),
    lambda b: ('0x' || b)::BIGINT)), lambda s, b: xor(s >> 8, t[xor(s & 255, b) + 1])), 4294967295) AS h FROM counted, crc),
words AS (SELECT CASE WHEN h % 199 = 0 THEN run[1:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word, sum(k)::BIGINT AS n FROM hashed GROUP BY 1),
v AS (SELECT * FROM words WHERE length(word) >= 6 AND n >= 5),
lacking AS (SELECT DISTINCT word, n, word[1:i - 1] || word[i + 1:] AS key FROM (SELECT *, unnest(range(1, length(word) + 1)) AS i FROM v)),
keys AS (SELECT * FROM lacking UNION SELECT word, n, word FROM v),
-- two words that share a key after at most one deletion each are near if they differ in one code point
near AS (SELECT DISTINCT a.word, a.n, b.word AS other, b.n AS m FROM keys a JOIN keys b ON a.key = b.key AND a.word <> b.word WHERE (
    length(a.word) = length(b.word) AND len(list_filter(range(1, length(a.word) + 1), lambda i: a.word[i] <> b.word[i])) = 1) OR (
    abs(length(a.word) - length(b.word)) = 1 AND (a.key = a.word OR b.key = b.word))),
forms AS (SELECT word, n, count(*) AS n_near, arg_min(other, (-m, other)) AS form, max(m) AS form_n FROM near GROUP BY word, n),
told AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 5 * v.n THEN form END AS form, CASE WHEN form_n >= 5 * v.n THEN form_n END AS form_n
  FROM v LEFT JOIN forms USING (word)),
chain(word, root) AS (SELECT word, word FROM told UNION ALL SELECT c.word, t.form FROM chain c JOIN told t ON t.word = c.root WHERE t.form IS NOT NULL),
ends AS (SELECT c.word, c.root FROM chain c JOIN told t ON t.word = c.root WHERE t.form IS NULL)
SELECT word, n, n_near, form, form_n, root FROM told JOIN ends USING (word)
"""
