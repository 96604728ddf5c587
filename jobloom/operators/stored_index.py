"""A stored inverted index: written once, read by the words that are asked.

Postings of a term are cut into blocks of equal length in the order of document and place; a block holds gaps between
document numbers, which are small, beside weights and places. Blocks lie in folders by a hash of their term, so a search
reads the folders of its words and, in them, their terms' blocks. A dictionary by the hash of the stem names the terms of
each stem with their folder, counts and blocks: text is indexed by its words as they stand, and a search by stem looks
the words up there, so only different words are ever stemmed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.stemming import stem
from .ordered import running, stored

#: Postings of a block, postings for each folder of terms, postings of a task, postings of a slice of a common term,
#: postings that a task packs at a time and the most of them in a piece.
BLOCK, FOLDER, TASK, RUN, PACK, PIECE = 4096, 4_000_000, 1_000_000, 250_000, 2_000_000, 4096
POSTING = "term string, id long, weight string, pos int"
PACKED = "term string, weight string, first long, last long, n int, body binary"
SLICED = "term string, slice int, weight string, first long, n int, body binary"
#: A block, or of a block that two slices share, one slice's part (not ``whole``), which begins at the term's posting ``at``.
PARTS = "term string, block long, at long, first long, last long, gaps array<long>, weights array<string>, places array<int>, n int, docs int, whole boolean, folder int"
#: Stands for an id that is null, before all others.
NONE = -(1 << 63)


def _folder(term: Column, folders: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(folders)).cast("int")


def write_index(index: DataFrame, folder: str, block: int = BLOCK, folders: int | None = None) -> StoredIndex:
    """Writes (term, id, weight, pos) rows, ids being whole numbers, as blocks and a dictionary below ``folder``.

    Postings are never shuffled as rows: tasks pack them by term, under four bytes each, and pieces are what is written
    between steps and sent once. A term with more than ``RUN`` postings is cut into slices of about as many by id, found from
    where its pieces begin; slices are counted, so each knows the place of its first posting and cuts the term's blocks where
    they belong. Only the two parts of a block at a slice's ends meet once more. All steps have a task for about ``TASK``
    postings. ``folders`` grows with the number of rows unless it is given.
    """
    spark = index.sparkSession
    rows = index.select("term", F.col("id").cast("long").alias("id"), "weight", F.col("pos").cast("int").alias("pos"))
    pieces = stored(rows.mapInArrow(_packer(PACK, min(PIECE, RUN)), PACKED), "index-pieces")
    total = pieces.agg(F.sum("n")).first()[0] or 0
    number = folders or max(1, math.ceil(total / FOLDER))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / TASK))

    common = stored(pieces.groupBy("term").agg(F.sum("n").alias("all")).filter(F.col("all") > RUN).select("term"), "index-common")  # total / RUN at most
    begins = pieces.select("term", "first", "last", "n").join(F.broadcast(common), "term")
    upto = running(begins, [F.asc("term"), F.asc("first"), F.asc("last")], F.col("n"), "index-begins")
    bounds = upto.filter(F.expr(f"(upto - n) div {RUN} < upto div {RUN}")).groupBy("term").agg(F.sort_array(F.collect_set("first")).alias("bounds"))
    bounds = stored(common.join(bounds, "term", "left").select("term", F.coalesce("bounds", F.array().cast("array<long>")).alias("bounds")), "index-bounds")
    wide = pieces.join(F.broadcast(bounds), "term", "left").select("term", "weight", "first", "n", "body", "bounds")
    counts = wide.filter("bounds IS NOT NULL").mapInArrow(_cut, SLICED).groupBy("term", "slice").agg(F.sum("n").alias("n"))
    by = Window.partitionBy("term")  # slices, of which a term has one for RUN postings
    starts = stored(counts.select("term", "slice", (F.sum("n").over(by.orderBy("slice")) - F.col("n")).alias("before"), F.sum("n").over(by).alias("all")), "index-slices")

    sliced = wide.mapInArrow(_cut, SLICED).join(F.broadcast(starts), ["term", "slice"], "left").withColumn("folder", _folder(F.col("term"), number))
    share = F.when(F.col("all").isNotNull(), F.xxhash64("term", "slice")).otherwise(F.pmod(F.xxhash64("term", F.lit(0)), F.lit(max(1, math.ceil(total / number / TASK)))))
    merged = sliced.repartition(tasks, "folder", share).sortWithinPartitions("folder", "term", "slice", "first").mapInArrow(_merger(block), PARTS)
    merged.sortWithinPartitions("whole", "folder", "term", "block").write.partitionBy("whole", "folder").parquet(f"{folder}/blocks")
    written = spark.read.schema(PARTS).parquet(f"{folder}/blocks")
    parts = written.filter("NOT whole").groupBy("folder", "term", "block").agg(F.sort_array(F.collect_list(F.struct("at", "first", "last", "gaps", "weights", "places", "n", "docs"))).alias("p"))  # ``block`` postings at most
    gaps = F.expr("flatten(transform(p, (x, i) -> IF(i = 0, x.gaps, concat(array(x.first - p[i - 1].last), slice(x.gaps, 2, size(x.gaps) - 1)))))")
    sums = [F.expr(f"aggregate(p, 0, (s, x) -> s + x.{c})").alias(c) for c in ("n", "docs")]
    joined = parts.select("term", "block", F.expr("p[0].at AS at"), F.expr("p[0].first AS first"), F.expr("p[size(p) - 1].last AS last"), gaps.alias("gaps"), F.expr("flatten(p.weights)").alias("weights"), F.expr("flatten(p.places)").alias("places"), *sums, "folder")
    joined.repartition("folder").sortWithinPartitions("folder", "term", "block").write.mode("append").partitionBy("folder").parquet(f"{folder}/blocks/whole=true")

    own = spark.read.schema(PARTS).parquet(f"{folder}/blocks/whole=true")
    sizes = own.groupBy("term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("places"), F.count("*").alias("blocks"))
    terms = sizes.select("term", stem(F.col("term")).alias("stem"), "docs", "places", "blocks", _folder(F.col("term"), number).alias("at")).withColumn("folder", _folder(F.col("stem"), number))
    terms.repartition("folder").sortWithinPartitions("stem", "term").write.partitionBy("folder").parquet(f"{folder}/terms")
    spark.createDataFrame([(number, block)], "folders int, block int").write.parquet(f"{folder}/about")
    return StoredIndex(spark, folder)


def _encoded(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unsigned numbers in bytes of seven bits, lowest first, and how many bytes each takes."""
    sizes = np.ones(len(values), np.int64)
    for k in range(1, 10):
        sizes += values >= np.uint64(1 << 7 * k)
    at = np.cumsum(sizes) - sizes
    out = np.empty(int(sizes.sum()), np.uint8)
    left = np.arange(len(values))
    for k in range(10):
        more = sizes[left] > k + 1
        out[at[left] + k] = (values[left] >> np.uint64(7 * k)).astype(np.uint8) & 127 | more.astype(np.uint8) << 7
        left = left[more]
    return out, sizes


def _decoded(data: np.ndarray) -> np.ndarray:
    ends = np.flatnonzero(data < 128)
    at = np.r_[0, ends[:-1] + 1]
    values = np.zeros(len(ends), np.uint64)
    left = np.arange(len(ends))
    for k in range(10):
        values[left] |= (data[at[left] + k] & 127).astype(np.uint64) << np.uint64(7 * k)
        left = left[at[left] + k < ends[left]]
    return values


def _bodies(ids: np.ndarray, pos: np.ndarray, starts: np.ndarray) -> pa.Array:
    """Pieces that begin at ``starts``: gaps between ids, and places, in the same document as gaps too."""
    gaps = np.diff(ids, prepend=ids[:1])
    gaps[starts] = 0
    again = gaps == 0
    again[starts] = False
    places = np.where(again, np.diff(pos, prepend=pos[:1]), pos)
    data, sizes = _encoded(np.stack([gaps, places], axis=1).ravel().view(np.uint64))
    ends = np.cumsum(sizes)[1::2]
    offsets = np.r_[0, ends[np.r_[starts[1:], len(ids)] - 1]].astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def _postings(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, id, pos) of the postings of pieces."""
    body = batch.column("body")
    offsets = np.frombuffer(body.buffers()[1], np.int32)[body.offset : body.offset + len(body) + 1]
    values = _decoded(np.frombuffer(body.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]).view(np.int64).reshape(-1, 2)
    sizes = batch.column("n").to_numpy()
    starts = np.cumsum(sizes, dtype=np.int64) - sizes
    sums, again = np.cumsum(values[:, 0]), values[:, 0] == 0
    again[starts] = False
    ids = sums + np.repeat(batch.column("first").to_numpy() - sums[starts], sizes)
    sums, heads = np.cumsum(values[:, 1]), np.flatnonzero(~again)
    pos = sums - np.repeat(sums[heads] - values[heads, 1], np.diff(np.r_[heads, len(sums)]))
    return np.repeat(np.arange(len(sizes)), sizes), ids, pos


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Whether a row differs from the one before in any column."""
    out = np.ones(len(columns[0]), bool)
    out[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return out


def _one(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.Table.from_batches(batches).combine_chunks().to_batches()[0]


def _shares(batch: pa.RecordBatch, heads: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """Pieces in shares of about ``PACK`` postings, parted at ``heads`` (rows) if these are given."""
    sizes = batch.column("n").to_numpy()
    heads = np.arange(len(sizes)) if heads is None else heads
    if len(sizes):
        cuts = heads[_changes((np.cumsum(sizes, dtype=np.int64) - sizes)[heads] // PACK)]
        yield from (batch.slice(a, b - a) for a, b in zip(cuts, [*cuts[1:], len(sizes)], strict=True))


def _packer(most: int, piece: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            if batch.num_rows:
                held, rows = [*held, batch], rows + batch.num_rows
            if rows >= most:
                yield packed(_one(held))
                held, rows = [], 0
        if held:
            yield packed(_one(held))

    def packed(batch: pa.RecordBatch) -> pa.RecordBatch:
        terms, weights = batch.column("term").dictionary_encode(), batch.column("weight").dictionary_encode()
        codes = terms.indices.to_numpy().astype(np.int64) * len(weights.dictionary) + weights.indices.to_numpy()
        ids, pos = batch.column("id").fill_null(NONE).to_numpy(), batch.column("pos").to_numpy().astype(np.int64)
        order = np.lexsort((pos, ids, codes))
        codes, ids, pos = codes[order], ids[order], pos[order]
        heads = np.flatnonzero(_changes(codes))
        nth = np.arange(len(codes)) - np.repeat(heads, np.diff(np.r_[heads, len(codes)]))
        starts = np.flatnonzero(nth % piece == 0)
        ends = np.r_[starts[1:], len(codes)]
        term, weight = np.divmod(codes[starts], len(weights.dictionary))
        columns = [terms.dictionary.take(pa.array(term)), weights.dictionary.take(pa.array(weight)), pa.array(ids[starts]), pa.array(ids[ends - 1]), pa.array((ends - starts).astype(np.int32)), _bodies(ids, pos, starts)]
        return pa.RecordBatch.from_arrays(columns, ["term", "weight", "first", "last", "n", "body"])

    return pack


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of common terms cut at their term's ``bounds``, others as they are."""
    names = ["term", "slice", "weight", "first", "n", "body"]
    for batch in batches:
        some = batch.column("bounds").is_valid()
        common, rest = batch.filter(some), batch.filter(pc.invert(some))
        if rest.num_rows:
            yield pa.RecordBatch.from_arrays([rest.column("term"), pa.array(np.zeros(rest.num_rows, np.int32)), *[rest.column(c) for c in names[2:]]], names)
        for few in _shares(common):
            row, ids, pos = _postings(few)
            bounds = few.column("bounds")
            ends = np.cumsum(few.column("n").to_numpy(), dtype=np.int64)
            slices = np.concatenate([np.searchsorted(bounds[i].values.to_numpy(), ids[e - n : e], "right") for i, (e, n) in enumerate(zip(ends, few.column("n").to_pylist(), strict=True))])
            starts = np.flatnonzero(_changes(row, slices))
            sizes, of = np.diff(np.r_[starts, len(ids)]).astype(np.int32), pa.array(row[starts])
            yield pa.RecordBatch.from_arrays([few.column("term").take(of), pa.array(slices[starts].astype(np.int32)), few.column("weight").take(of), pa.array(ids[starts]), pa.array(sizes), _bodies(ids, pos, starts)], names)


def _merger(block: int):
    """Sorted pieces of whole slices as blocks, those of about ``PACK`` postings and a slice at a time."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held, rows = [*held, batch], rows + pc.sum(batch.column("n")).as_py()
            if rows >= PACK:
                whole = _one(held)
                heads = np.flatnonzero(groups(whole))
                if heads[-1]:
                    yield from map(merged, _shares(whole.slice(0, heads[-1]), heads[:-1]))
                    held = [whole.slice(heads[-1])]
                    rows = pc.sum(held[0].column("n")).as_py()
        if held:
            whole = _one(held)
            yield from map(merged, _shares(whole, np.flatnonzero(groups(whole))))

    def groups(batch: pa.RecordBatch) -> np.ndarray:
        return _changes(batch.column("term").dictionary_encode().indices.to_numpy(), batch.column("slice").to_numpy())

    def merged(batch: pa.RecordBatch) -> pa.RecordBatch:
        row, ids, pos = _postings(batch)
        weights = batch.column("weight").dictionary_encode()
        ranks = pc.rank(weights.dictionary, tiebreaker="dense").to_numpy().astype(np.int64)[weights.indices.to_numpy()]
        heads = groups(batch)
        group, weight = np.cumsum(heads)[row] - 1, ranks[row]
        order = np.lexsort((pos, weight, ids, group))
        group, weight, ids, pos, row = group[order], weight[order], ids[order], pos[order], row[order]
        opens = np.flatnonzero(_changes(group))
        sizes = np.diff(np.r_[opens, len(ids)])
        before = batch.column("before").fill_null(0).to_numpy()[heads]
        last = batch.column("all").fill_null(0).to_numpy()[heads]  # the number of a common term's postings
        last = np.where(last == 0, sizes, last)
        at = np.arange(len(ids)) - np.repeat(opens - before, sizes)
        starts = np.flatnonzero(_changes(group, at // block))
        n = np.diff(np.r_[starts, len(ids)])
        new = (_changes(group, ids) & (ids != NONE)).astype(np.int64)
        gaps = np.diff(ids, prepend=ids[:1])
        gaps[starts] = 0
        upto = at[starts] + n
        whole = (at[starts] % block == 0) & ((upto % block == 0) | (upto == last[group[starts]]))
        of, offsets = pa.array(row[starts]), pa.array(np.r_[starts, len(ids)].astype(np.int32))
        names = weights.dictionary.take(pc.sort_indices(weights.dictionary))
        lists = [pa.ListArray.from_arrays(offsets, x) for x in (pa.array(gaps), names.take(pa.array(weight - 1)), pa.array(pos.astype(np.int32)))]
        columns = [batch.column("term").take(of), pa.array(at[starts] // block), pa.array(at[starts]), pa.array(ids[starts]), pa.array(ids[starts + n - 1]), *lists]
        columns += [pa.array(n.astype(np.int32)), pa.array(np.add.reduceat(new, starts).astype(np.int32)), pa.array(whole), batch.column("folder").take(of)]
        return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in PARTS.split(", ")])

    return merge


class StoredIndex:
    """An index that ``write_index`` has written."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self.folders = spark.read.parquet(f"{folder}/about").first()["folders"]

    def terms(self) -> DataFrame:
        """(term, stem, docs, places, blocks) of every term."""
        kinds = "term string, stem string, docs long, places long, blocks long, at int, folder int"
        return self.spark.read.schema(kinds).parquet(f"{self.folder}/terms")

    def blocks(self) -> DataFrame:
        kinds = "term string, block long, first long, gaps array<long>, weights array<string>, places array<int>, folder int"
        return self.spark.read.schema(kinds).parquet(f"{self.folder}/blocks/whole=true")

    def lookup(self, words: DataFrame, stemmed: bool = False) -> DataFrame:
        """Postings (term, id, weight, pos) of the column ``term`` of ``words``; by stem, ``term`` is the stem.

        Only folders of asked words are read: their numbers, of which there are at most ``folders``, come to the driver.
        """
        asked = words.select(F.col("term").alias("asked")).distinct()
        if stemmed:
            wide = self._in(self.terms(), "folder", asked.select(_folder(stem(F.col("asked")), self.folders)))
            stems = asked.select(stem(F.col("asked")).alias("stem")).distinct()
            named = wide.join(stems, "stem").select("term", F.col("stem").alias("asked"), "at")
        else:
            named = asked.select(F.col("asked").alias("term"), "asked", _folder(F.col("asked"), self.folders).alias("at"))
        found = self._in(self.blocks(), "folder", named.select("at")).join(named, "term").drop("folder", "at")
        return found.select("asked", "first", "gaps", "weights", "places").mapInArrow(_unpacked, POSTING)

    @staticmethod
    def _in(df: DataFrame, column: str, numbers: DataFrame) -> DataFrame:
        wanted = sorted(r[0] for r in numbers.distinct().collect())
        return df.filter(F.col(column).isin(wanted)) if wanted else df.limit(0)


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks as postings: document numbers are running sums of gaps."""
    for batch in batches:
        gaps = batch.column("gaps")
        if not batch.num_rows:
            continue
        starts = gaps.offsets.to_numpy() - gaps.offsets[0].as_py()
        sizes = np.diff(starts)
        sums = np.cumsum(gaps.flatten().to_numpy())
        before = np.r_[0, sums][starts[:-1]]
        ids = sums + np.repeat(batch.column("first").to_numpy() - before, sizes)
        rows = pa.array(np.repeat(np.arange(batch.num_rows), sizes))
        yield pa.RecordBatch.from_arrays([batch.column("asked").take(rows), pa.array(ids, mask=ids == NONE), batch.column("weights").flatten(), batch.column("places").flatten()], ["term", "id", "weight", "pos"])
