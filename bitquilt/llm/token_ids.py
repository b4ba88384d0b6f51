"""Token ids in binary files: frequency ranks in a byte-aligned variable-length code with separate control bytes.

Ids are replaced by their rank by frequency over all documents, so that frequent tokens take one byte. A control byte
holds the lengths (1 to 4 bytes) of four ranks, the data bytes follow apart, so that a block is decoded by numpy with
one table lookup for the lengths and one for the masks, without a loop over ids.

A folder written by `write_token_ids` holds
    _ranks          ids by rank, little-endian unsigned 32-bit
    _index          Parquet: a row per file in the order of the documents: name, documents and ids before it and in it
    part-*.ids      MAGIC, then blocks: four unsigned 64-bit numbers (documents, ids, control bytes, data bytes),
                    doc ids (64-bit), one byte per doc id that is set (1) or null (0), ids per document (64-bit),
                    control bytes, data bytes
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from .text import LOWER, mix, packed_rows, powers, seeds
from .token_counts import byte_alphabet

MAGIC = b"BQIDS001"
#: Words whose ids a task keeps (and eight ids for each); beyond it they are asked of the library anew, which costs time only.
KNOWN_WORDS = 2_000_000
#: Kinds of bytes: white space, marks that are pieces apart from letters and digits next to them, ASCII letters and digits, others.
KIND = np.full(256, 3, np.uint8)
MARK, ALNUM = 1, 2
KIND[list(b" \t\n\r\x0b\x0c")] = 0
KIND[list(b".,;:!?")] = MARK
KIND[[*range(48, 58), *range(65, 91), *range(97, 123)]] = ALNUM
#: Words of letters that no normalizer changes but for their case, and the visible characters that stand for their bytes.
LETTERS = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+").fullmatch
BYTES = {c: "".join(byte_alphabet()[b] for b in chr(c).encode()) for c in range(0xC0, 0x100)}
#: Table of the hash of a word.
SALT = seeds(256, 21) | np.uint64(1)

#: Code lengths of the four ranks under each control byte, and the bits that a code of each length keeps.
LENGTHS = (np.arange(256, dtype=np.uint8)[:, None] >> np.array([0, 2, 4, 6], np.uint8) & 3) + 1
MASKS = np.array([0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], np.uint32)


def pack_ranks(ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Control bytes and data bytes of unsigned 32-bit ranks."""
    ranks = np.ascontiguousarray(ranks, "<u4")
    sizes = 1 + (ranks >= 1 << 8).astype(np.uint8) + (ranks >= 1 << 16) + (ranks >= 1 << 24)
    codes = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    codes[:len(ranks)] = sizes - 1
    a, b, c, d = codes.reshape(-1, 4).T
    data = ranks.view(np.uint8).reshape(-1, 4)[np.arange(4) < sizes[:, None]]
    return a | b << 2 | c << 4 | d << 6, data


def unpack_ranks(control: np.ndarray, data: np.ndarray, n: int) -> np.ndarray:
    """The n ranks of control and data bytes."""
    sizes = LENGTHS[control].reshape(-1)[:n]
    if not n:
        return np.empty(0, np.uint32)
    starts = np.cumsum(sizes, dtype=np.int64) - sizes
    padded = np.concatenate([data, np.zeros(3, np.uint8)])
    return np.ndarray(len(data), "<u4", padded, strides=(1,))[starts] & MASKS[sizes]


class WordTable:
    """Numbers of words by two 64-bit hashes, in an open-addressed table that is probed for many words at once."""

    def __init__(self, bits: int) -> None:
        self.mask = np.uint64((1 << bits) - 1)
        self.first, self.second = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.uint64)
        self.number = np.full(1 << bits, -1, np.int32)

    def find(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Number of each word, or -1."""
        out = np.full(len(first), -1, np.int64)
        open_, place = np.arange(len(first)), first & self.mask
        while len(open_):
            number = self.number[place]
            hit = (number >= 0) & (self.first[place] == first[open_]) & (self.second[place] == second[open_])
            out[open_[hit]] = number[hit]
            on = ~hit & (number >= 0)
            open_, place = open_[on], (place[on] + np.uint64(1)) & self.mask
        return out

    def add(self, first: np.ndarray, second: np.ndarray, start: int) -> None:
        """Distinct new words, numbered from `start`; the table has to have room."""
        open_, place = np.arange(len(first)), first & self.mask
        while len(open_):
            free = self.number[place] < 0
            self.number[place[free]] = open_[free] + start  # of several claims one stays
            won = self.number[place] == open_ + start
            self.first[place[won]], self.second[place[won]] = first[open_[won]], second[open_[won]]
            open_, place = open_[~won], (place[~won] + np.uint64(1)) & self.mask


def split_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of rows that stand end to end, their two hashes (A-Z as a-z), and the words' offsets by row.

    The first hash is of all bytes, the second of the length and the first and last eight bytes. Words end at white space, and where marks and ASCII letters or digits meet.
    """
    kind = KIND[data]
    inside = kind > 0
    first = inside.copy()
    first[1:] &= (kind[:-1] == 0) | ((kind[1:] ^ kind[:-1]) == ALNUM ^ MARK)
    edges = offsets[:-1][offsets[:-1] < len(data)]
    first[edges] = inside[edges]
    starts = np.flatnonzero(first)
    where = np.flatnonzero(inside)
    if not len(starts):
        none = np.empty(0, np.uint64)
        return starts, starts, none, none, np.zeros(len(offsets), np.int64)
    heads = np.flatnonzero(first[where])
    sizes = np.diff(np.concatenate([heads, [len(where)]]))
    within = np.arange(len(where)) - np.repeat(heads, sizes)
    low, longest = LOWER[data], int(sizes.max())
    eight = np.ndarray(len(data) + 9, "<u8", np.concatenate([np.zeros(8, np.uint8), low, np.zeros(8, np.uint8)]), strides=(1,))
    head = eight[starts + 8] & (~np.uint64(0) >> (8 * (8 - np.minimum(sizes, 8))).astype(np.uint64))
    tail = np.where(sizes > 8, eight[starts + sizes], np.uint64(0))
    with np.errstate(over="ignore"):
        one = mix(np.add.reduceat(SALT[low[where]] * powers(longest)[within], heads))
        two = mix(head ^ mix(tail + sizes.astype(np.uint64)))
    return starts, starts + sizes, one, two, np.searchsorted(starts, offsets)


class WordIds:
    """Ids of whole texts, put together from the library's ids of their words.

    The vocabulary's normalizer and pre-tokenizer drop white space and join nothing across it, letters or digits and the
    marks next to them are pieces of their own, and no special string holds either; so the ids of a text are those of
    its words, one after the other, and upper case makes no difference. Texts with a special string's first characters, or
    with combining marks, which may join with the letter before them, take the library's whole way.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        self.forget()

    def forget(self, room: int = 0) -> None:
        self.table = WordTable(max(KNOWN_WORDS, room).bit_length() + 1)
        self.ids = np.empty(1 << 20, np.uint32)
        #: ends[i], ends[i + 1]: where the ids of word i are
        self.ends = np.zeros(1 << 18, np.int64)
        self.n = 0

    def ids_of(self, words: list[bytes]) -> list[list[int]]:
        """A word of ASCII and composed Latin letters is one piece, which goes to the model at once; others take the library's whole way."""
        texts = [w.decode("utf-8", "replace") for w in words]
        plain = [LETTERS(t) is not None for t in texts]
        others = iter(self.library.encode_batch_fast([t for t, p in zip(texts, plain, strict=True) if not p], add_special_tokens=False))
        tokenize = self.model.tokenize
        return [[x.id for x in tokenize(t.lower().translate(BYTES))] if p else next(others).ids for t, p in zip(texts, plain, strict=True)]

    def learn(self, words: list[bytes], first: np.ndarray, second: np.ndarray) -> None:
        found = self.ids_of(words)
        flat = [i for ids in found for i in ids]
        start = int(self.ends[self.n])
        while self.n + len(found) >= len(self.ends):
            self.ends = np.concatenate([self.ends, np.zeros_like(self.ends)])
        while start + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.empty_like(self.ids)])
        self.ids[start:start + len(flat)] = flat
        self.ends[self.n + 1:self.n + 1 + len(found)] = start + np.cumsum([len(ids) for ids in found])
        self.table.add(first, second, self.n)
        self.n += len(found)

    def whole(self, text: bytes) -> np.ndarray:
        return np.array(self.library.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids, np.uint32)

    def encode(self, data: np.ndarray, offsets: np.ndarray, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows, one after the other, and their number per row; `end_id` closes each."""
        odd = (data == 0xCC) | (data == 0xCD)
        odd[:-1] |= (data[:-1] == ord("<")) & (data[1:] == ord("|"))
        apart = np.unique(np.searchsorted(offsets, np.flatnonzero(odd), "right") - 1)
        if len(apart):
            return self.encode_apart(data, offsets, end_id, set(apart.tolist()))
        starts, ends, first, second, rows = split_words(data, offsets)
        at = self.table.find(first, second)
        new = np.flatnonzero(at < 0)
        if len(new):
            new = new[np.unique(first[new], return_index=True)[1]]
            if max(self.n + len(new), int(self.ends[self.n]) >> 3) > KNOWN_WORDS:
                self.forget(len(first))
                new = np.unique(first, return_index=True)[1]
            self.learn([data[x:y].tobytes().lower() for x, y in zip(starts[new], ends[new], strict=True)], first[new], second[new])
            at = self.table.find(first, second)
        sizes = self.ends[at + 1] - self.ends[at]
        total = np.concatenate([[0], np.cumsum(sizes)])
        flat = self.ids[np.arange(total[-1]) + np.repeat(self.ends[at] - total[:-1], sizes)]
        bounds = total[rows]
        if end_id is None:
            return flat, np.diff(bounds)
        return np.insert(flat, bounds[1:], np.uint32(end_id)), np.diff(bounds) + 1

    def encode_apart(self, data: np.ndarray, offsets: np.ndarray, end_id: int | None, apart: set[int]) -> tuple[np.ndarray, np.ndarray]:
        ids, counts, close = [], [], np.array([] if end_id is None else [end_id], np.uint32)
        for i in range(len(offsets) - 1):
            own = data[offsets[i]:offsets[i + 1]]
            if i in apart:
                ids += [self.whole(own.tobytes()), close]
                counts.append(len(ids[-2]) + len(close))
            else:
                found, size = self.encode(own, np.array([0, len(own)]), end_id)
                ids.append(found)
                counts.append(int(size[0]))
        return np.concatenate(ids), np.array(counts, np.int64)


_encoders: dict[str, WordIds] = {}


def encoder_of(path: str) -> WordIds:
    if path not in _encoders:
        _encoders[path] = WordIds(path)
    return _encoders[path]


def vocabulary_size(path: str) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True)


def id_counts(docs: DataFrame, path: str, end_id: int | None, size: int) -> DataFrame:
    """id and n over the texts of all documents: counted per task by bincount, then summed; at most `size` rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, total = encoder_of(path), np.zeros(size, np.int64)
        for batch in batches:
            for _, _, data, rows in packed_rows(batch.column(0)):
                total += np.bincount(encoder.encode(data, rows, end_id)[0], minlength=size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at])], names=["id", "n"])

    return docs.select("text").mapInArrow(count, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n"))


def ids_by_rank(counts: DataFrame, size: int) -> np.ndarray:
    """All ids of the vocabulary, the most frequent first, equal ones by id. The driver sees one count per id at most."""
    total = np.zeros(size, np.int64)
    for row in counts.collect():
        total[row["id"]] = row["n"]
    return np.lexsort((np.arange(size), -total)).astype("<u4")


def filesystem(path: str):
    """The file system of a path or URI, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def read_ranks(path: str) -> np.ndarray:
    files, folder = filesystem(path)
    with files.open_input_stream(f"{folder}/_ranks") as f:
        return np.frombuffer(f.read(), "<u4")


@dataclass
class Written(WriterCommitMessage):
    partition: int
    name: str
    documents: int
    ids: int


@dataclass
class IdFile(InputPartition):
    name: str
    ids_before: int


class TokenIdWriter(DataSourceArrowWriter):
    """Encodes and writes rows (doc_id, text) in the order in which they come; a task's file counts only once the job is committed."""

    def __init__(self, path: str, vocabulary: str, end_id: int | None) -> None:
        self.path, self.vocabulary, self.end_id = path, vocabulary, end_id

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        import uuid

        from pyspark import TaskContext

        files, folder = filesystem(self.path)
        by_rank = read_ranks(self.path)
        rank_of = np.empty(len(by_rank), np.uint32)
        rank_of[by_rank] = np.arange(len(by_rank), dtype=np.uint32)
        partition = TaskContext.get().partitionId()
        done = Written(partition, f"part-{partition:06d}-{uuid.uuid4().hex}.ids", 0, 0)
        encoder = encoder_of(self.vocabulary)
        with files.open_output_stream(f"{folder}/{done.name}") as out:
            out.write(MAGIC)
            for batch in iterator:
                doc_ids = batch.column(0)
                for a, b, data, rows in packed_rows(batch.column(1)):
                    ids, counts = encoder.encode(data, rows, self.end_id)
                    control, packed = pack_ranks(rank_of[ids])
                    own = doc_ids.slice(a, b - a)
                    out.write(np.array([b - a, len(ids), len(control), len(packed)], "<u8").tobytes())
                    out.write(own.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8").tobytes())
                    out.write(np.asarray(own.is_valid()).astype(np.uint8).tobytes())
                    out.write(counts.astype("<i8").tobytes())
                    out.write(control.tobytes())
                    out.write(packed.tobytes())
                    done.documents += b - a
                    done.ids += len(ids)
        return done

    def commit(self, messages: list) -> None:
        import pyarrow.parquet as pq

        done = sorted((m for m in messages if m is not None), key=lambda m: m.partition)
        n = np.array([m.documents for m in done], np.int64), np.array([m.ids for m in done], np.int64)
        files, folder = filesystem(self.path)
        index = pa.table({
            "name": pa.array([m.name for m in done], pa.string()), "documents_before": np.cumsum(n[0]) - n[0], "ids_before": np.cumsum(n[1]) - n[1],
            "documents": n[0], "ids": n[1],
        })
        pq.write_table(index, f"{folder}/_index", filesystem=files)

    def abort(self, messages: list) -> None:
        files, folder = filesystem(self.path)
        for m in messages:
            if m is not None:
                files.delete_file(f"{folder}/{m.name}")


class TokenIdReader(DataSourceReader):
    """One partition per file that the index names."""

    def __init__(self, path: str) -> None:
        self.path = path

    def partitions(self) -> list[IdFile]:
        import pyarrow.parquet as pq

        files, folder = filesystem(self.path)
        index = pq.read_table(f"{folder}/_index", filesystem=files)
        found = [IdFile(r["name"], r["ids_before"]) for r in index.to_pylist() if r["documents"]]
        return found or [IdFile("", 0)]

    def read(self, partition: IdFile) -> Iterator[pa.RecordBatch]:
        if not partition.name:
            return
        files, folder = filesystem(self.path)
        by_rank = read_ranks(self.path)
        start = partition.ids_before
        with files.open_input_stream(f"{folder}/{partition.name}") as f:
            if f.read(len(MAGIC)) != MAGIC:
                raise ValueError(f"{partition.name} is no file of token ids")
            while head := f.read(32):
                n, n_ids, n_control, n_data = (int(x) for x in np.frombuffer(head, "<u8"))
                doc_ids, valid = np.frombuffer(f.read(8 * n), "<i8"), np.frombuffer(f.read(n), np.uint8)
                counts = np.frombuffer(f.read(8 * n), "<i8")
                ranks = unpack_ranks(np.frombuffer(f.read(n_control), np.uint8), np.frombuffer(f.read(n_data), np.uint8), n_ids)
                ends = np.cumsum(counts)
                offsets = pa.py_buffer(np.concatenate([[0], ends * 4]).astype(np.int64))
                ids = pa.Array.from_buffers(pa.large_binary(), n, [None, offsets, pa.py_buffer(by_rank[ranks])]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc_ids, mask=valid == 0), pa.array(start + ends - counts), pa.array(counts), ids], names=["doc_id", "start", "n_tokens", "ids"],
                )
                start += n_ids


class TokenIds(DataSource):
    """Spark's view of a folder of token ids: `format("token_ids")`, option `path`; to write also `vocabulary` and maybe `end_id`."""

    @classmethod
    def name(cls) -> str:
        return "token_ids"

    def schema(self) -> str:
        return "doc_id bigint, start bigint, n_tokens bigint, ids binary"

    def reader(self, schema: StructType) -> TokenIdReader:
        return TokenIdReader(self.options["path"])

    def writer(self, schema: StructType, overwrite: bool) -> TokenIdWriter:
        end_id = self.options.get("end_id")
        return TokenIdWriter(self.options["path"], self.options["vocabulary"], None if end_id is None else int(end_id))


def in_order(docs: DataFrame) -> DataFrame:
    """The documents in ascending doc_id order over all partitions: nulls first, equal ids by text.

    Rows that share an id are dealt to several ranges by a hash of the text and their place in the input, so that none of them need
    hold all; rows equal in both are interchangeable.
    """
    rows = docs.select("doc_id", "text").withColumns({"_hash": F.xxhash64("text"), "_place": F.monotonically_increasing_id()})
    order = [F.col("doc_id").asc_nulls_first(), F.col("_hash").asc(), F.col("_place").asc()]
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("_hash", "_place")


def write_token_ids(docs: DataFrame, vocabulary: str, path: str, end_id: int | None = None) -> None:
    """Encode all texts with the tokenizer file `vocabulary` and write them to the new folder `path` in doc_id order.

    Texts are encoded twice, to count the ids and to write them, so no copy of all ids is kept. Null or empty texts have the end id alone (or no id).
    Rows with a null or repeated doc_id are kept: nulls first, equal ids by a hash of the text. No documents: no ids. A text of any
    length is encoded whole, in one row and one block.
    """
    given = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    size = max(vocabulary_size(vocabulary), 0 if end_id is None else end_id + 1)
    by_rank = ids_by_rank(id_counts(given, vocabulary, end_id, size), size)
    files, folder = filesystem(path)
    files.create_dir(folder, recursive=True)
    with files.open_output_stream(f"{folder}/_ranks") as f:
        f.write(by_rank.tobytes())
    docs.sparkSession.dataSource.register(TokenIds)
    writer = in_order(given).write.format("token_ids").mode("append").option("path", path).option("vocabulary", vocabulary)
    (writer if end_id is None else writer.option("end_id", str(end_id))).save()


def read_token_ids(spark: SparkSession, path: str) -> DataFrame:
    """The documents of a folder: doc_id, start (ids of all documents before it), n_tokens, ids (little-endian unsigned 32-bit)."""
    spark.dataSource.register(TokenIds)
    return spark.read.format("token_ids").option("path", path).load()
