"""Token counts of every prefix by dynamic programming over byte-level BPE.

The encoding of a prefix ends in exactly one token t such that the encoding of what stands before t, followed by t,
is stable under the merges; so count(prefix) = count(prefix without t) + 1. The states of short words are shared by all
words of a task; a long word has the counts of all its prefixes in an array of its own. A shorter prefix is looked up
there, so no text is encoded again for it, and a word of n letters takes time and memory in proportion to n.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import mix, powers, spans_of

#: Kept prefix states and word counts of a task; beyond it they are built anew, which costs time only.
STATES = 300_000
#: Words longer than this have the counts of their prefixes in an array of their own.
LONG_WORD = 48
#: Longer words are counted anew where they come again in another batch, so that kept words stay small.
KEPT_WORD = 512
LETTER, NUMBER, OTHER, BLANK, UNKNOWN = range(5)
#: The contractions of the byte-level pattern.
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")


def byte_alphabet() -> dict[int, str]:
    """The visible character that stands for each byte in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class PrefixCounts:
    """Exact token counts of prefixes for one vocabulary file (byte-level BPE of the tokenizers library)."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        # one object for each token, so that a state holds no copy of its text
        self.tokens = {t: t for t in spec["model"]["vocab"]}
        self.ranks = {tuple(m if isinstance(m, list) else m.split(" ")): i for i, m in enumerate(spec["model"]["merges"])}
        self.tails = {t[i:] for t in self.tokens for i in range(len(t))}
        self.special = [t["content"] for t in spec["added_tokens"]]
        # the leftmost one counts, of these the longest
        self.specials = re.compile("|".join(re.escape(t) for t in sorted(self.special, key=len, reverse=True)))
        self.alphabet = byte_alphabet()
        self.split = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
        self.classes = np.full(0x110000, UNKNOWN, np.uint8)
        self.parents = {a + b: (a, b) for a, b in self.ranks}
        self.spines: tuple[dict, dict] = ({}, {})
        self.alone: dict[str, bool] = {}
        self.stable: dict[tuple[str, str], bool] = {}
        self.states: dict[str, tuple[int, str]] = {"": (0, "")}
        self.counts: dict[str, int] = {}

    # -- dynamic programming over the prefixes of a word --

    def merged(self, text: str) -> list[str]:
        parts = list(text)
        while len(parts) > 1:
            rank, at = min((self.ranks.get((a, b), 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if rank == 1 << 60:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def spine(self, token: str, side: int) -> list[tuple[str, int, float]]:
        """The parts of a token that once stood at one edge (0 left, 1 right): part, rank that made it, rank that used it up."""
        known = self.spines[side].get(token)
        if known is None:
            known, part, used = [], token, float("inf")
            while True:
                made = self.ranks.get(self.parents[part], -1) if part in self.parents else -1
                known.append((part, made, used))
                if part not in self.parents:
                    break
                part, used = self.parents[part][side], made
            self.spines[side][token] = known
        return known

    def follows(self, before: str, token: str) -> bool:
        """Whether the merges leave `before` and `token` side by side: none joins parts across their border."""
        if not before:
            known = self.alone.get(token)
            if known is None:
                known = self.alone[token] = self.merged(token) == [token]
            return known
        known = self.stable.get((before, token))
        if known is None:
            if len(self.stable) > STATES:
                self.stable.clear()
            known, ranks = True, self.ranks
            for x, made_x, used_x in self.spine(before, 1):
                for y, made_y, used_y in self.spine(token, 0):
                    rank = ranks.get((x, y))
                    # at equal ranks the merge on the left comes first
                    if rank is not None and made_x < rank < used_x and made_y < rank <= used_y:
                        known = False
                        break
                if not known:
                    break
            self.stable[before, token] = known
        return known

    def endings(self, text: str, end: int) -> list[str]:
        """Tokens that end at `end`, the longest first."""
        found, start = [], end - 1
        while start >= 0 and (tail := text[start:end]) in self.tails:
            if tail in self.tokens:
                found.append(self.tokens[tail])
            start -= 1
        return found[::-1]

    def step(self, text: str, state) -> tuple[int, str]:
        """State of `text` from the states of shorter prefixes."""
        for token in self.endings(text, len(text)):
            count, last = state(text[:-len(token)])
            if self.follows(last, token):
                return count + 1, token
        raise ValueError("the vocabulary has no encoding of a byte")

    def state(self, text: str) -> tuple[int, str]:
        """(count, last token) of a prefix; shared by all words that begin with it."""
        known = self.states.get(text)
        if known is None:
            known = self.states[text] = self.step(text, self.state)
        return known

    def prefix_counts(self, word: str) -> np.ndarray:
        """Tokens of each prefix of a pre-token, from no character to all: a pass over its bytes."""
        text, counts, lasts = self.shown(word), array("i", [0]), [""]
        for end in range(1, len(text) + 1):
            for token in self.endings(text, end):
                before = end - len(token)
                if self.follows(lasts[before], token):
                    counts.append(counts[before] + 1)
                    lasts.append(token)
                    break
            else:
                raise ValueError("the vocabulary has no encoding of a byte")
        codes = np.frombuffer(word.encode("utf-32-le", "replace"), np.uint32)
        sizes = 1 + (codes >= 0x80).astype(np.int64) + (codes >= 0x800) + (codes >= 0x10000)
        return np.frombuffer(counts, np.int32)[np.concatenate([[0], np.cumsum(sizes)])]

    def shown(self, word: str) -> str:
        return word.encode("utf-8", "replace").decode("latin-1").translate(self.alphabet)

    def count(self, word: str) -> int:
        """Tokens of one pre-token."""
        known = self.counts.get(word)
        if known is None:
            if len(self.states) > STATES:
                self.states = {"": (0, "")}
            if len(self.counts) > STATES:
                self.counts.clear()
            shown = self.shown(word)
            known = self.state(shown)[0] if len(shown) <= LONG_WORD else int(self.prefix_counts(word)[-1])
            if len(word) <= KEPT_WORD:
                self.counts[word] = known
        return known

    # -- pre-tokens --

    def classify(self, codes: np.ndarray) -> np.ndarray:
        """Class of each code point; new ones are asked of the library's own splitter."""
        kinds = self.classes[codes]
        if (kinds == UNKNOWN).any():
            for code in np.unique(codes[kinds == UNKNOWN]).tolist():
                joined = [len(self.split(c + chr(code))) == 1 for c in "a1!"]
                self.classes[code] = joined.index(True) if any(joined) else BLANK
            kinds = self.classes[codes]
        return kinds

    def word_starts(self, text: str, codes: np.ndarray, firsts: np.ndarray) -> np.ndarray:
        """Starts of the pre-tokens of segments that stand end to end; firsts: where the segments begin."""
        n = len(codes)
        if not n:
            return np.empty(0, np.int64)
        kinds = self.classify(codes)
        edge = np.zeros(n, bool)
        edge[firsts[firsts < n]] = True
        change = edge.copy()
        change[1:] |= kinds[1:] != kinds[:-1]
        run = np.flatnonzero(change)
        blank = kinds[run] == BLANK
        starts = change.copy()
        # the last blank before other text stands alone, or leads the next word if it is a space
        nexts = run[1:]
        led = nexts[blank[:-1] & ~edge[nexts]]
        starts[led - 1] = True
        starts[led[codes[led - 1] == 32]] = False
        for at in np.flatnonzero((codes == 39) & starts[:n]).tolist():
            for tail in CONTRACTIONS:
                end = at + len(tail)
                if text.startswith(tail, at) and not edge[at + 1:end].any():
                    starts[at + 1:end] = False
                    if end < n and not edge[end] and kinds[end] == LETTER:
                        starts[end] = True
                    break
        return np.flatnonzero(starts)

    def word_counts(self, text: str, codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Tokens of each pre-token; equal ones are counted once."""
        if not len(starts):
            return np.empty(0, np.int64)
        ends = np.append(starts[1:], len(codes))
        word = np.repeat(np.arange(len(starts)), ends - starts)
        within = np.arange(len(codes)) - starts[word]
        with np.errstate(over="ignore"):
            sums = np.add.reduceat(mix(codes.astype(np.uint64) + np.uint64(1)) * powers(int(within.max()) + 1)[within], starts)
            keys = sums * np.uint64(2) + (ends - starts).astype(np.uint64)
        _, first, back = np.unique(keys, return_index=True, return_inverse=True)
        counted = np.fromiter((self.count(text[a:b]) for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)), np.int64, len(first))
        return counted[back]

    def segments(self, text: str) -> list[tuple[str, bool]]:
        """Pieces of a text: ordinary ones and special strings, which are one token each."""
        pieces, end = [], 0
        for hit in self.specials.finditer(text):
            pieces += [(text[end:hit.start()], False)] * (hit.start() > end) + [(hit.group(), True)]
            end = hit.end()
        return pieces + [(text[end:], False)] * (end < len(text))

    def tables(self, texts: list[str]) -> Iterator[PrefixTable]:
        """The prefix table of each text; the texts are handled together."""
        pieces = [[(t, False)] * bool(t) if not any(s in t for s in self.special) else self.segments(t) for t in texts]
        flat = [p for x in pieces for p in x]
        joined = "".join(p[0] for p in flat)
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        sizes = np.array([len(p[0]) for p in flat], np.int64)
        firsts = np.concatenate([[0], np.cumsum(sizes)])[:-1] if len(flat) else np.empty(0, np.int64)
        starts = self.word_starts(joined, codes, firsts)
        single = np.array([p[1] for p in flat], bool)
        if single.any():
            owner = np.searchsorted(firsts, starts, "right") - 1
            keep = ~single[owner] | (starts == firsts[owner])
            starts = starts[keep]
            counts = self.word_counts(joined, codes, starts)
            counts[single[owner[keep]]] = 1
        else:
            counts = self.word_counts(joined, codes, starts)
        at = 0
        for text, own in zip(texts, pieces, strict=True):
            a, b = np.searchsorted(starts, [at, at + len(text)])
            yield PrefixTable(self, text, starts[a:b] - at, np.concatenate([[0], np.cumsum(counts[a:b])]), own)
            at += len(text)


class PrefixTable:
    """Counts of all prefixes of one text: sums at the pre-tokens, shared states inside them."""

    def __init__(self, model: PrefixCounts, text: str, starts: np.ndarray, sums: np.ndarray, pieces: list) -> None:
        self.model, self.text, self.starts, self.sums, self.pieces = model, text, starts, sums, pieces
        self.firsts = np.concatenate([[0], np.cumsum([len(p) for p, _ in pieces])]).astype(np.int64)
        self.runs: tuple[np.ndarray, np.ndarray] | None = None
        self.inside: tuple[tuple[int, int], np.ndarray] | None = None

    @property
    def total(self) -> int:
        return int(self.sums[-1])

    def blanks(self, chars: int) -> tuple[int, int]:
        """The run of blanks, or of other characters, around the last of so many characters."""
        if self.runs is None:
            codes = np.frombuffer(self.text.encode("utf-32-le", "surrogatepass"), np.uint32)
            blank = self.model.classes[codes] == BLANK
            edges = np.flatnonzero(np.append(True, blank[1:] != blank[:-1]))
            self.runs = edges, np.append(edges[1:], len(codes))
        at = int(np.searchsorted(self.runs[0], chars - 1, "right")) - 1
        return int(self.runs[0][at]), int(self.runs[1][at])

    def part(self, start: int, end: int, chars: int) -> int:
        """Tokens of text[start:chars] within the word, or run of blanks, text[start:end]."""
        if end - start <= LONG_WORD:
            return self.model.count(self.text[start:chars])
        # prefixes are asked for word by word: the counts of one long word are kept
        if self.inside is None or self.inside[0] != (start, end):
            self.inside = (start, end), self.model.prefix_counts(self.text[start:end])
        return int(self.inside[1][chars - start])

    def at(self, chars: int) -> int:
        """Tokens of text[:chars]."""
        if chars <= 0:
            return 0
        text, model = self.text, self.model
        if chars >= len(text):
            return self.total
        word = int(np.searchsorted(self.starts, chars - 1, "right")) - 1
        piece = int(np.searchsorted(self.firsts, chars - 1, "right")) - 1
        first, end = int(self.firsts[piece]), int(self.firsts[piece + 1])
        special = self.pieces[piece][1]
        if special and chars == end:
            return int(self.sums[word + 1])
        if special:  # a cut special string is ordinary text that continues the text before it
            back = word - 1 if word and self.before(piece) else word
            return self.recount(self.join(piece, back), chars)
        if model.classes[ord(text[chars - 1])] == BLANK:
            run, over = self.blanks(chars)
            start = max(run, first)
            word = int(np.searchsorted(self.starts, start, "right")) - 1
            return int(self.sums[word]) + self.part(start, min(over, end), chars)
        start = int(self.starts[word])
        part = text[start:min(chars, start + 3)]
        if chars - start == 2 and part in ("'r", "'v", "'l"):
            return int(self.sums[word]) + model.count("'") + model.count(part[1]) if self.end(word) > chars else int(self.sums[word + 1])
        return int(self.sums[word]) + self.part(start, self.end(word), chars)

    def end(self, word: int) -> int:
        return int(self.starts[word + 1]) if word + 1 < len(self.starts) else len(self.text)

    def before(self, piece: int) -> str:
        """The ordinary piece before this one, or nothing."""
        return self.pieces[piece - 1][0] if piece and not self.pieces[piece - 1][1] else ""

    def join(self, piece: int, back: int) -> int:
        """Where to count again for a prefix that cuts the special string at this piece."""
        first, before = int(self.firsts[piece]), self.before(piece)
        if not before:
            return first
        start, low = int(self.starts[back]), first - len(before)
        if start > low and self.model.classes[ord(self.text[start - 1])] == BLANK:
            start = max(self.blanks(start)[0], low)
        return start

    def recount(self, start: int, chars: int) -> int:
        tail = self.text[start:chars]
        codes = np.frombuffer(tail.encode("utf-32-le", "surrogatepass"), np.uint32)
        starts = self.model.word_starts(tail, codes, np.zeros(1, np.int64))
        word = int(np.searchsorted(self.starts, start, "left"))
        return int(self.sums[word]) + int(self.model.word_counts(tail, codes, starts).sum())

    def within(self, budget: int) -> int:
        """The most leading characters that take at most `budget` tokens."""
        if self.total <= budget:
            return len(self.text)
        # sums only grow from word to word, and a part of a word takes at least one token
        word = min(int(np.searchsorted(self.sums, budget, "right")), len(self.starts) - 1)
        chars = min(self.end(word) + 1, len(self.text))
        while chars > 0 and self.at(chars) > budget:
            chars -= 1
            start, end = self.inside[0] if self.inside else (0, 0)
            if start + 2 < chars < end:  # all these prefixes end in the long word whose counts are at hand
                base = int(self.sums[int(np.searchsorted(self.starts, start, "right")) - 1])
                fit = np.flatnonzero(self.inside[1][3:chars - start + 1] <= budget - base)
                chars = start + (3 + int(fit[-1]) if len(fit) else 2)
        return chars


_models: dict[str, PrefixCounts] = {}


def model_of(path: str) -> PrefixCounts:
    if path not in _models:
        _models[path] = PrefixCounts(path)
    return _models[path]


def token_prefixes(docs: DataFrame, path: str, budget: int, id_col: str = "doc_id", text_col: str = "text", prefixes: bool = False) -> DataFrame:
    """Exact token counts, and the cut that keeps a text within `budget` tokens.

    One row per input row: `id_col`, n_bytes, n_tokens, cut_chars (the most leading characters of at most `budget`
    tokens), and with `prefixes` also prefix_tokens: the count of every prefix, from 0 characters to all of them.
    A null text is empty (0 bytes, 0 tokens); ids may be null or repeat and are passed on; other columns are left out.
    An empty table gives none. A text may be one word of any length: time and memory grow in proportion to it.
    Each text is whole in its own row, so there is no shuffle.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_bytes bigint, n_tokens bigint, cut_chars bigint" + ", prefix_tokens array<int>" * prefixes

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of(path)
        for batch in batches:
            sizes = batch.column(1).to_numpy(zero_copy_only=False)
            for a, b in spans_of(sizes, 1 << 19):
                texts = [x or "" for x in batch.column(2).slice(a, b - a).to_pylist()]
                rows = list(model.tables(texts))
                columns = [batch.column(0).slice(a, b - a), pa.array(sizes[a:b], pa.int64()), pa.array([t.total for t in rows], pa.int64()), pa.array([t.within(budget) for t in rows], pa.int64())]
                if prefixes:
                    columns.append(pa.array([[t.at(i) for i in range(len(t.text) + 1)] for t in rows], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, names=[id_col, "n_bytes", "n_tokens", "cut_chars"] + ["prefix_tokens"] * prefixes)

    size = F.coalesce(F.octet_length(text_col), F.lit(0)).cast("bigint")
    return docs.select(F.col(id_col), size.alias("n_bytes"), F.col(text_col).alias("text")).mapInArrow(count, schema)
