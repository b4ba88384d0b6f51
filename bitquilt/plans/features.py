"""Feature planner: member specs to packed words.

Members share work by construction: each distinct xform is computed once,
each distinct (xform, channel) once, each encoding of it once; only then the
results fan out to members. All of it happens inside the sample's row.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.encodings import encode_array
from ..functions.words import pack_array
from ..operators.grid import Shape, apply_xform
from ..operators.stencil import with_channel


@dataclass(frozen=True)
class Member:
    member_id: int
    xform: str
    channel: str
    encoding: str
    width: int = 8
    slice: int = 0
    slices: int = 1

    @property
    def spec(self) -> str:
        return f"{self.xform}:{self.channel}:{self.encoding}{self.width}"


def slice_bounds(index: int, slices: int, n_words: int) -> tuple[int, int]:
    """Container range [start, end) of one slice."""
    return index * n_words // slices, (index + 1) * n_words // slices


def _numbered(values: Sequence) -> dict:
    return {v: i for i, v in enumerate(dict.fromkeys(values))}


def build_features(samples: DataFrame, members: Sequence[Member], shape: Shape) -> DataFrame:
    """(member_id, sample_id, split, label, words) for all members of one batch."""
    xforms = _numbered([m.xform for m in members])
    channels = _numbered([(m.xform, m.channel) for m in members])
    codes = _numbered([(m.xform, m.channel, m.encoding, m.width) for m in members])
    df = samples.withColumns({f"_x{i}": apply_xform(F.col("px"), x, shape) for x, i in xforms.items()})
    for (x, channel), i in channels.items():
        df = with_channel(df, channel, shape, f"_x{xforms[x]}", f"_c{i}")
    # one plane is left after the channel
    df = df.withColumns({
        f"_w{i}": pack_array(encode_array(F.col(f"_c{channels[x, ch]}"), e, w), w, shape.size)
        for (x, ch, e, w), i in codes.items()
    })

    def words(m: Member) -> Column:
        i = codes[m.xform, m.channel, m.encoding, m.width]
        n_words = shape.size * m.width // 32
        start, end = slice_bounds(m.slice, m.slices, n_words)
        whole = F.col(f"_w{i}")
        return whole if m.slices == 1 else F.slice(whole, start + 1, end - start)

    rows = F.array(*[F.struct(F.lit(m.member_id).cast("bigint").alias("member_id"), words(m).alias("words")) for m in members])
    return df.select("sample_id", "split", "label", F.inline(rows)).select("member_id", "sample_id", "split", "label", "words")


def row_members(base: Member, shape: Shape) -> list[Member]:
    """One member per grid row: the row's words are a slice."""
    return [
        Member(base.member_id + y, base.xform, base.channel, base.encoding, base.width, y, shape.height)
        for y in range(shape.height)
    ]


def batches(members: Sequence[Member], size: int = 64) -> list[list[Member]]:
    """Sort by xform and channel so that a batch shares its grids."""
    ordered = sorted(members, key=lambda m: (m.xform, m.channel, m.encoding, m.width, m.slice))
    return [ordered[i : i + size] for i in range(0, len(ordered), size)]
