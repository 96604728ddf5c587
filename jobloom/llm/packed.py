"""Counting 64-bit hashes of a whole corpus in packed blocks.

A map task hashes a block of documents and sends each bucket (a range of hash values) one row with all of the
block's hashes there: seven bytes a hash, as the bucket stands for the first one, and one or two bytes for the place
it has in the block. A reduce task counts the hashes of its bucket with numpy and answers each block with the places
whose hash counts. A block's answers then meet its directory, which names its documents. A hash that is common within
a block is sent only as often as the count needs, so no bucket grows with a group of copies, and a block's group is
bounded by the block.

The number of buckets is a multiple of 256, so that a bucket does give the first byte and hashes keep all 64 bits.
It grows with the input, so that a bucket stays small. Beyond ``MOST`` buckets a block's rows would hold too few
hashes each; then the blocks' rows meet in wider ranges first, several blocks make up one block of hashes of such a
range, and that one is sent on to the range's buckets.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, mixed, partitions, stored

#: Rows between the steps. kind 0: hashes for a bucket; 1: directory of a block; 2: answer to a block; 3: directory of
#: a block that was made of others. Answers hold places in ``a`` and what is known of each place in ``b`` and ``c``.
SCHEMA = "block long, bucket long, kind int, a binary, b binary, c binary, d binary"
FIELDS = [f.split()[0] for f in SCHEMA.split(", ")]
BINARY = [("block", pa.int64()), ("bucket", pa.int64()), ("kind", pa.int32()), *((x, pa.binary()) for x in "abcd")]
#: Bytes of text behind one bucket, and bytes of text for each byte of the files that are read.
BUCKET_BYTES, EXPANSION = 32 << 20, 4
#: Buckets to which a block sends rows.
MOST = 24_576


class Buckets:
    """``first`` ranges of hashes, each cut into ``second`` buckets; ``parts`` groups of blocks share a range."""

    def __init__(self, wanted: int, most: int = MOST):
        wanted = -(-max(wanted, 1) // 256) * 256
        self.first = wanted if wanted <= most else -(-math.isqrt(wanted) // 256) * 256
        self.second = self.parts = -(-wanted // self.first)

    @classmethod
    def of(cls, df: DataFrame) -> Buckets:
        """Two for each shuffle partition, more where the input's size asks for it."""
        size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
        return cls(max(2 * partitions(df.sparkSession), size * EXPANSION // BUCKET_BYTES if size < 1 << 60 else 0))

    def ranges(self, hashes: np.ndarray) -> np.ndarray:
        return ((hashes >> np.uint64(32)) * np.uint64(self.first) >> np.uint64(32)).astype(np.int64)

    def within(self, hashes: np.ndarray) -> np.ndarray:
        """Bucket of each hash within its range."""
        rest = (hashes >> np.uint64(32)) * np.uint64(self.first) & np.uint64(0xFFFFFFFF)
        return (rest * np.uint64(self.second) >> np.uint64(32)).astype(np.int64)

    def home(self, block: int) -> int:
        """A range for the directory of a block."""
        return int(mixed(np.array([block], np.int64).view(np.uint64))[0] % np.uint64(self.first))

    def top(self, of_range: int) -> int:
        return (of_range << 8) // self.first


def packed_gaps(places: np.ndarray, wide: bool = True) -> bytes:
    """Ascending places as gaps of one (or two) bytes; a full byte means that the gap goes on."""
    full, kind = (65535, np.uint16) if wide else (255, np.uint8)
    gaps = np.diff(places.astype(np.int64), prepend=0)
    more = gaps // full
    ends = np.cumsum(more + 1) - 1
    out = np.full(int(ends[-1]) + 1 if len(ends) else 0, full, kind)
    out[ends] = gaps % full
    return out.tobytes()


def unpacked_gaps(raw: bytes, wide: bool = True) -> np.ndarray:
    full, kind = (65535, np.uint16) if wide else (255, np.uint8)
    gaps = np.frombuffer(raw, kind)
    return np.cumsum(gaps, dtype=np.int64)[gaps < full]


def seven(hashes: np.ndarray) -> bytes:
    """The low seven bytes of each hash."""
    return np.ascontiguousarray(hashes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :7]).tobytes()


def eight(raw: bytes, top: int) -> np.ndarray:
    """Hashes from their low seven bytes and the first byte."""
    low = np.frombuffer(raw, np.uint8).reshape(-1, 7)
    full = np.empty((len(low), 8), np.uint8)
    full[:, :7] = low
    full[:, 7] = top
    return full.view("<u8").reshape(-1).astype(np.uint64)


def table(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(BINARY)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, BINARY, strict=True)], FIELDS)


def block_rows(block: int, hashes: np.ndarray, places: np.ndarray, at: np.ndarray, wide: bool, extra: np.ndarray | None = None) -> Iterator[tuple]:
    """One row a bucket ``at``. ``places`` ascend; ``extra`` are counts, sent where they exceed 1."""
    order = np.argsort(at, kind="stable")
    hashes, places, at = hashes[order], places[order], at[order]
    extra = None if extra is None else extra[order]
    ends = np.flatnonzero(np.r_[at[1:] != at[:-1], True]) + 1 if len(at) else []
    start = 0
    for end in ends:
        more = b""
        if extra is not None and (many := np.flatnonzero(extra[start:end] > 1)).size:
            more = np.stack([many, extra[start:end][many]]).astype(np.uint32).tobytes()
        yield block, int(at[start]), 0, seven(hashes[start:end]), packed_gaps(places[start:end], wide), more, b""
        start = end


def sent(block: int, hashes: np.ndarray, places: np.ndarray, buckets: Buckets, extra: np.ndarray | None = None) -> Iterator[tuple]:
    """The rows of a block of documents to the ranges of its hashes."""
    return block_rows(block, hashes, places, buckets.ranges(hashes), buckets.first > 512, extra)


def block_number(count: int) -> int:
    """A number of this task's count-th block, the same when the task runs again."""
    return (TaskContext.get().partitionId() << 32) | count


class Bucket:
    """The rows of one bucket: all hashes, the row each came in, and its extra count."""

    def __init__(self, rows: pa.Table, top: int, wide: bool):
        self.blocks, self.wide = rows.column("block").to_pylist(), wide
        raw = rows.column("a").to_pylist()
        self.gaps = rows.column("b").to_pylist()
        self.sizes = [len(x) // 7 for x in raw]
        self.hashes = eight(b"".join(raw), top)
        self.counts = np.ones(len(self.hashes), np.int64)
        start = 0
        for size, more in zip(self.sizes, rows.column("c").to_pylist(), strict=True):
            if more:
                at, many = np.frombuffer(more, np.uint32).reshape(2, -1)
                self.counts[start + at.astype(np.int64)] = many
            start += size

    def totals(self) -> np.ndarray:
        """For each hash, the sum of counts over all its occurrences in the bucket."""
        if not len(self.hashes):
            return self.counts
        order = np.argsort(self.hashes, kind="stable")
        first = np.flatnonzero(np.r_[True, self.hashes[order][1:] != self.hashes[order][:-1]])
        sums = np.add.reduceat(self.counts[order], first)
        out = np.empty(len(order), np.int64)
        out[order] = np.repeat(sums, np.diff(np.r_[first, len(order)]))
        return out

    def answers(self, chosen: np.ndarray, known: list[np.ndarray]) -> Iterator[tuple]:
        """One row a block: the places of its chosen hashes, and of each what is known."""
        start = 0
        for block, size, gaps in zip(self.blocks, self.sizes, self.gaps, strict=True):
            mine = chosen[start : start + size]
            if mine.any():
                about = [k[start : start + size][mine].tobytes() for k in known] + [b""] * (2 - len(known))
                yield block, 0, 2, packed_gaps(unpacked_gaps(gaps, self.wide)[mine]), *about, b""
            start += size


def exchanged(rows: DataFrame, buckets: Buckets, choose: Callable, known: list, assemble: Callable, schema: str) -> DataFrame:
    """Map rows -> ``choose`` for each bucket -> ``assemble`` for each block.

    ``choose`` takes a Bucket and returns which hashes are answered and, for each entry of ``known`` (numpy types), an
    array of what is told about every hash. ``assemble`` takes a block's directory row and its ``Answers``.
    """
    two = buckets.second > 1

    def answered(group: pa.Table) -> pa.Table:
        kinds = group.column("kind").to_numpy()
        of_range = group.column("bucket")[0].as_py() // (buckets.second if two else 1)
        own = Bucket(group.filter(pa.array(kinds == 0)), buckets.top(of_range), two or buckets.first > 512)
        out = table(list(own.answers(*choose(own))))
        give_back()
        return pa.concat_tables([group.filter(pa.array(kinds != 0)), pa.Table.from_batches([out])])

    def joined(group: pa.Table) -> pa.Table:
        """Rows of several blocks in one range as one block, for the range's buckets."""
        kinds = group.column("kind").to_numpy()
        of_range, part = group.column("bucket")[0].as_py(), group.column("part")[0].as_py()
        group = group.select(FIELDS)
        own = Bucket(group.filter(pa.array(kinds == 0)), buckets.top(of_range), buckets.first > 512)
        block, at = of_range * buckets.parts + part, of_range * buckets.second + buckets.within(own.hashes)
        parts = np.array([*zip(own.blocks, own.sizes, map(len, own.gaps), strict=True)], np.int64)
        head = (block, of_range * buckets.second, 3, parts.tobytes(), b"".join(own.gaps), b"", b"")
        out = table([head, *block_rows(block, own.hashes, np.arange(len(own.hashes)), at, True, own.counts)])
        return pa.concat_tables([group.filter(pa.array(kinds == 1)).set_column(1, "bucket", pa.array([of_range * buckets.second] * int((kinds == 1).sum()), pa.int64())), pa.Table.from_batches([out])])

    def parted(group: pa.Table) -> pa.Table:
        """Answers to a block that was made of others, as answers to those."""
        heads = group.filter(pa.array(group.column("kind").to_numpy() == 3)).to_pylist()
        told = Answers(group.filter(pa.array(group.column("kind").to_numpy() == 2)), known)
        parts, order = np.frombuffer(heads[0]["a"], np.int64).reshape(-1, 3), np.argsort(told.places, kind="stable")
        places, about, out, first, gap = told.places[order], [k[order] for k in told.known], [], 0, 0
        for block, size, width in parts.tolist():
            low, high = np.searchsorted(places, [first, first + size])
            if high > low:
                mine = unpacked_gaps(heads[0]["b"][gap : gap + width], buckets.first > 512)[places[low:high] - first]
                out.append((block, 0, 2, packed_gaps(mine), *[k[low:high].tobytes() for k in about], *[b""] * (2 - len(about)), b""))
            first, gap = first + size, gap + width
        return pa.Table.from_batches([table(out)])

    def assembled(group: pa.Table) -> pa.Table:
        kinds = group.column("kind").to_numpy()
        (head,) = group.filter(pa.array(kinds == 1)).to_pylist()
        return assemble(head, Answers(group.filter(pa.array(kinds == 2)), known))

    if two:
        rows = rows.withColumn("part", F.pmod(F.xxhash64("block"), F.lit(buckets.parts)))
        rows = rows.groupBy("bucket", "part").applyInArrow(joined, SCHEMA)
    told = rows.groupBy("bucket").applyInArrow(answered, SCHEMA)
    if two:
        told = stored(told, "answers")
        told = told.filter("kind = 1").union(told.filter("kind > 1").groupBy("block").applyInArrow(parted, SCHEMA))
    return told.groupBy("block").applyInArrow(assembled, schema)


class Answers:
    """What a block was told: places, in no order, and for each place an array of each kind."""

    def __init__(self, rows: pa.Table, known: list):
        self.places = np.concatenate([np.zeros(0, np.int64), *map(unpacked_gaps, rows.column("a").to_pylist())])
        self.known = [np.concatenate([np.zeros(0, k), *(np.frombuffer(x, k) for x in rows.column(c).to_pylist())]) for c, k in zip("bc", known, strict=False)]
