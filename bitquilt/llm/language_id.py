"""Language identification with hyperdimensional profiles.

Every letter has a random vector of signs; an n-gram is the product of its letters' vectors, each rotated by its place;
a text, and a language, is the sum of its n-grams; the language whose profile has the largest cosine wins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .text import mix, spans_of

DIMENSIONS = 1024
GRAM = 3
BOUNDARY = 0x110000
UNDETERMINED = "und"
#: Learned languages are held by every task: more distinct values than this are refused, not cut.
MOST_LANGUAGES = 2000
#: Distinct n-grams of a chunk that are turned into vectors at once.
BLOCK = 1500

_kinds: dict[str, np.ndarray] = {}


def letter_codes() -> np.ndarray:
    """Code point to letter (itself), or the boundary for everything that is no letter."""
    if "letters" not in _kinds:
        codes = np.arange(0x110000, dtype=np.int64)
        is_letter = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
        _kinds["letters"] = np.where(is_letter, codes, BOUNDARY)
    return _kinds["letters"]


def letter_vectors(codes: np.ndarray, dimensions: int) -> np.ndarray:
    """A row of +1 and -1 per letter, a function of the letter alone."""
    words = (dimensions + 63) // 64
    with np.errstate(over="ignore"):
        bits = mix((codes.astype(np.uint64)[:, None] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) + np.arange(words, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
    signs = np.unpackbits(bits.view(np.uint8), axis=1)[:, :dimensions]
    return signs.astype(np.float32) * 2 - 1


def gram_vectors(grams: np.ndarray, dimensions: int) -> np.ndarray:
    """Bind the letters of each n-gram: rotate by place, multiply."""
    letters, back = np.unique(grams, return_inverse=True)
    table = letter_vectors(letters, dimensions)
    back = back.reshape(grams.shape)
    out = np.ones((len(grams), dimensions), np.float32)
    for place in range(grams.shape[1]):
        out *= np.roll(table, grams.shape[1] - 1 - place, axis=1)[back[:, place]]
    return out


def gram_counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct letter n-grams of lower-cased texts, (row, gram, count) of each text, and whether it has a letter."""
    lowered = [t.lower() for t in texts]
    joined = " ".join([""] + lowered + [""])
    codes = letter_codes()[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)]
    row = np.repeat(np.arange(len(texts) + 1), [1] + [len(t) + 1 for t in lowered])[:len(codes)] - 1
    letters, small = np.unique(codes, return_inverse=True)
    base = len(letters)
    n = len(codes) - GRAM + 1
    if n <= 0 or base == 1:
        return np.empty((0, GRAM), np.int64), np.empty((0, 2), np.int64), np.empty(0, np.int64), np.zeros(len(texts), bool)
    blank = small == base - 1 if letters[-1] == BOUNDARY else np.zeros(len(small), bool)
    # an n-gram stands inside a word or at its border: its middle letters are letters, and it holds one at all
    use = ~blank[1:1 + n] if GRAM == 3 else ~blank[GRAM // 2:GRAM // 2 + n]
    key = np.zeros(n, np.int64)
    for place in range(GRAM):
        key = key * base + small[place:place + n]
    key, where = key[use], row[GRAM // 2:GRAM // 2 + n][use]
    has = np.zeros(len(texts), bool)
    has[where] = True
    if base ** GRAM <= 1 << 21:
        seen = np.zeros(base ** GRAM, bool)
        seen[key] = True
        distinct = np.flatnonzero(seen)
        place_of = np.zeros(base ** GRAM, np.int64)
        place_of[distinct] = np.arange(len(distinct))
        gram = place_of[key]
    else:
        distinct, gram = np.unique(key, return_inverse=True)
    cells, counts = _counted(where * len(distinct) + gram, len(texts) * len(distinct))
    grams = np.stack([letters[(distinct // base ** (GRAM - 1 - p)) % base] for p in range(GRAM)], axis=1)
    return grams, np.stack([cells // len(distinct), cells % len(distinct)], axis=1), counts, has


def _counted(cells: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    if size <= 1 << 22:
        counts = np.bincount(cells, minlength=size)
        at = np.flatnonzero(counts)
        return at, counts[at]
    return np.unique(cells, return_counts=True)


def text_vectors(texts: list[str], dimensions: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bundled vector of each text, whether it has a letter, and its number of n-grams; n-grams are bound in blocks."""
    grams, cells, counts, has = gram_counts(texts)
    out = np.zeros((len(texts), dimensions), np.float32)
    total = np.bincount(cells[:, 0], counts, len(texts))
    order = np.argsort(cells[:, 1], kind="stable") if len(grams) > BLOCK else slice(None)
    cells, counts = cells[order], counts[order]
    bounds = np.searchsorted(cells[:, 1], np.arange(0, len(grams) + BLOCK, BLOCK)) if len(grams) > BLOCK else [0, len(cells)]
    for i, at in enumerate(range(0, len(grams), BLOCK)):
        part = slice(bounds[i], bounds[i + 1])
        dense = np.zeros((len(texts), min(BLOCK, len(grams) - at)), np.float32)
        dense[cells[part, 0], cells[part, 1] - at] = counts[part]
        out += dense @ gram_vectors(grams[at:at + BLOCK], dimensions)
    return out, has, total


def held_out(doc_id: Column) -> Column:
    """Documents that nothing is learned from: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def learn_profiles(labelled: DataFrame, dimensions: int = DIMENSIONS) -> dict[str, np.ndarray]:
    """Language to profile from (text, lang): the sums of all n-grams of all its texts."""
    return learn_sized(labelled, dimensions)[0]


def learn_sized(labelled: DataFrame, dimensions: int = DIMENSIONS) -> tuple[dict[str, np.ndarray], dict[str, int]]:
    """The profiles of `learn_profiles`, and how many n-grams each sums.

    Each task bundles what it reads into one integer vector per language; Spark adds them up, so neither order nor the
    number of tasks matters. Only languages x dimensions numbers reach the driver.
    """

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = np.array(batch.column(1).to_pylist(), object)
            for a, b in spans_of(batch.column(2).to_numpy(zero_copy_only=False)):
                texts = batch.column(0).slice(a, b - a).to_pylist()
                own = langs[a:b]
                for lang in sorted(set(own)):
                    # one text per language: n-grams never join texts, so its counts are the sums
                    sums[lang] = sums.get(lang, 0) + bundled("\n".join(t for t, x in zip(texts, own, strict=True) if x == lang), dimensions)
        for lang, total in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([total.tolist()], pa.list_(pa.int64()))], names=["lang", "sums"])

    rows = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", "lang", F.octet_length("text").cast("bigint").alias("n"))
    parts = rows.mapInArrow(bundle, "lang string, sums array<bigint>")
    added = parts.select("lang", F.posexplode("sums").alias("at", "value")).groupBy("lang", "at").agg(F.sum("value").alias("value"))
    whole = added.groupBy("lang").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "value"))), lambda x: x["value"]).alias("sums"))
    found = whole.limit(MOST_LANGUAGES + 1).collect()
    if len(found) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages to learn")
    known = [r for r in found if any(r["sums"][:dimensions])]
    return {r["lang"]: np.array(r["sums"][:dimensions], np.float64) for r in known}, {r["lang"]: r["sums"][dimensions] for r in known}


def bundled(text: str, dimensions: int) -> np.ndarray:
    """The sum of a text's n-grams, and after it their number."""
    grams, cells, counts, _ = gram_counts([text])
    total = np.zeros(dimensions, np.int64)
    per_gram = np.zeros(len(grams), np.float64)
    per_gram[cells[:, 1]] = counts
    for at in range(0, len(grams), BLOCK):
        total += np.rint(per_gram[at:at + BLOCK] @ gram_vectors(grams[at:at + BLOCK], dimensions).astype(np.float64)).astype(np.int64)
    return np.append(total, counts.sum())


def predict_languages(
    docs: DataFrame, profiles: dict[str, np.ndarray], dimensions: int = DIMENSIONS, keep: list[str] | None = None, totals: dict[str, int] | None = None,
) -> DataFrame:
    """The columns of `keep` (doc_id), lang_pred, score: the language of the largest cosine, and that cosine, not below 0.

    A text that is null or has no letter is `und` with score 0, as is any text if nothing was learned. Ties go to the
    language that comes first. Whole texts are read; each row is judged alone, so repeated rows get equal results.
    With `totals`, the profiles' numbers of n-grams, there is one more column: `expected`, the cosine that a text of
    as many n-grams, repeated as often, has on average if they are drawn from that language (at most 1).
    """
    keep = keep or ["doc_id"]
    names = sorted(profiles)
    # the length of a vector by n-gram: the cosine expected is the profile's by the text's
    per_gram = np.array([np.linalg.norm(profiles[n]) / totals[n] for n in names]) if totals else None
    columns = [*keep, "lang_pred", "score", *(["expected"] if totals else [])]
    matrix = np.stack([profiles[n] / np.linalg.norm(profiles[n]) for n in names], axis=1).astype(np.float32) if names else np.zeros((dimensions, 0), np.float32)
    schema = StructType([docs.schema[c] for c in keep]).add("lang_pred", "string").add("score", "double")
    if totals:
        schema.add("expected", "double")

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_columns
            for a, b in spans_of(batch.column(n - 1).to_numpy(zero_copy_only=False)):
                texts = [t or "" for t in batch.column(n - 2).slice(a, b - a).to_pylist()]
                vectors, has, grams = text_vectors(texts, dimensions)
                lengths = np.linalg.norm(vectors, axis=1)
                known = has & (lengths > 0) & bool(names)
                cosines = vectors @ matrix / np.where(lengths > 0, lengths, 1)[:, None]
                best = cosines.argmax(axis=1) if names else np.zeros(len(texts), np.int64)
                lang = [names[i] if ok else UNDETERMINED for i, ok in zip(best, known, strict=True)]
                score = [float(min(max(cosines[r, i], 0.0), 1.0)) if ok else 0.0 for r, (i, ok) in enumerate(zip(best, known, strict=True))]
                found = [pa.array(lang, pa.string()), pa.array(score, pa.float64())]
                if totals:
                    expected = per_gram[best] * grams / np.where(lengths > 0, lengths, 1)
                    found.append(pa.array(np.where(known, np.minimum(expected, 1.0), 0.0), pa.float64()))
                yield pa.RecordBatch.from_arrays([*[batch.column(i).slice(a, b - a) for i in range(n - 2)], *found], names=columns)

    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint")
    return docs.select(*keep, F.col("text").alias("_text"), size.alias("_size")).mapInArrow(predict, schema)
