"""N-gram Jaccard join by rare-first prefix filtering.

One pass over the texts sends the hashes of every document's distinct word n-grams to be counted over the corpus
(see ``packed``); each document gets back those that other documents share, with their frequencies. N-grams are
ordered by (frequency, hash), rarest first, so a document's prefix is first used up by n-grams of its own, which
join with nothing.

The sets are joined on their prefix n-grams: not set by set, which would write out all pairs of a group of copies, but
set by chunk. A set belongs to the chunk of a frequent n-gram of its prefix, so similar sets mostly share one; chunks
are bounded, larger ones are dealt by hash. Each n-gram has a row for each chunk that holds it, with the range of sizes
and of places there, and joins with the sets that have it under the length and positional filters. So a set goes to
those chunks, once each, in which some set has an n-gram of its prefix at a place that leaves room for the overlap, and
each pair of sets meets in one pair of chunks. There the prefix n-grams are joined set by set under the same filters,
the suffix filter bounds the overlap by counts of n-grams in ranges of hashes, and what remains is verified exactly,
once a pair.

Documents with equal sets are one from the start. Only links that join something new leave a group, as a forest,
so no pairs of a group of copies are ever written out.

Defined results: null text, and text without words, has an empty set, size 0 and links with nothing; fewer words than
n make the whole sequence one n-gram; rows with one id are one document; a null id never becomes a class id, and
a row of null id in a class of null ids alone has a null class. N-grams and sets are known by 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLOCK_WORDS, checked, give_back, mixed, pieces, powers, read_table, rolling, stored, utf8, word_hashes
from .components import components
from .packed import SCHEMA, Answers, Bucket, Buckets, block_number, exchanged, sent, table

WIDTH, PERCENT = 5, 75
#: Sets of a chunk and n-grams of a chunk, about; a group holds two chunks.
CHUNK, CHUNK_GRAMS = 1024, 2_000_000
#: Hash ranges of the suffix filter.
RANGES = 32

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def needed(a, b, percent: int = PERCENT):
    """Least overlap o of sets of a and b with 100 * o >= percent * (a + b - o)."""
    return -(-(a + b) * percent // (100 + percent))


def prefix_length(n, percent: int = PERCENT):
    """N-grams of a set of n in rare-first order of which two linked sets share at least one."""
    return n - -(-n * percent // 100) + 1


def shingle_sets(raws: list[bytes], width: int = WIDTH) -> list[np.ndarray]:
    """Ascending distinct hashes of the n-grams of each lower-cased text."""
    split = [raw.translate(_LOWER).split() for raw in raws]
    sizes = np.array([len(s) for s in split], np.int64)
    hashes = word_hashes([w for s in split for w in s])
    windows, out, at = rolling(hashes, width), [], 0
    for n in sizes:
        if n >= width:
            out.append(np.unique(windows[at : at + n - width + 1]))
        elif n:
            whole = (hashes[at : at + n] * powers(int(n))[0][:n]).sum(dtype=np.uint64)
            out.append(mixed(np.array([whole + np.uint64(n)], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
        at += n
    return out


def shared_sets(df: DataFrame, text_col: str, id_col: str, width: int = WIDTH, percent: int = PERCENT, buckets: Buckets | None = None) -> DataFrame:
    """One row per document: doc_id, n, key of its set; ``grams`` (shared ones, rarest first), ``prefix`` and ``cell``.

    ``prefix`` of the ``grams`` lie in the set's prefix. ``cell`` is the one of these with the least hash among the
    most frequent, by powers of two. A block gives the grams of equal sets once.
    """
    n_buckets = buckets or Buckets.of(df)

    def send(batches):
        count = 0
        for batch in batches:
            ids, raws, size = [], [], 0
            for doc, raw in zip(batch.column("doc_id").to_pylist(), utf8(batch.column("__text")), strict=True):
                if raws and size + len(raw) > 6 * BLOCK_WORDS:
                    yield table(_block(block_number(count), ids, raws, width, n_buckets))
                    ids, raws, size, count = [], [], 0, count + 1
                ids.append(doc)
                raws.append(raw)
                size += len(raw)
            if raws:
                yield table(_block(block_number(count), ids, raws, width, n_buckets))
                count += 1
            give_back()

    def choose(own: Bucket) -> tuple:
        totals = own.totals()
        # Frequencies only order n-grams, so they may stop at a largest value, which is the same everywhere.
        return totals > 1, [np.minimum(totals, 65535).astype(np.uint16), own.hashes]

    def assemble(head: dict, told: Answers) -> pa.Table:
        docs = np.frombuffer(head["a"], np.int64).reshape(-1, 4)  # id, id is null, size, key
        first = np.frombuffer(head["b"], np.int64)  # first place of the set, -1 if an earlier row has it
        others, firsts = np.frombuffer(head["c"], np.uint32).reshape(2, -1).astype(np.int64)
        total = int(docs[first >= 0, 2].sum())
        counts, hashes = np.zeros(total, np.int64), np.zeros(total, np.uint64)
        counts[told.places], hashes[told.places] = told.known
        counts[others], hashes[others] = counts[firsts], hashes[firsts]
        grams, prefix, cell = [], [], []
        for (_, _, n, _), start in zip(docs.tolist(), first.tolist(), strict=True):
            if start < 0 or not n:
                grams.append(None)
                prefix.append(0)
                cell.append(0)
                continue
            mine = slice(start, start + n)
            some = np.flatnonzero(counts[mine] > 1)
            c, h = counts[mine][some], hashes[mine][some]
            order = np.lexsort((h, c))
            length = min(len(some), max(0, prefix_length(n, percent) - (n - len(some))))
            grams.append(h[order].tobytes())
            prefix.append(length)
            level = np.log2(c[order[:length]]).astype(int)
            cell.append(int(h[order[:length]][level == level[-1]].min().astype(np.int64)) if length else 0)
        ids = pa.array(docs[:, 0], mask=docs[:, 1] == 1)
        return pa.table({"doc_id": ids, "n": docs[:, 2], "key": docs[:, 3], "grams": pa.array(grams, pa.binary()), "prefix": pa.array(prefix, pa.int64()), "cell": pa.array(cell, pa.int64())})

    own = df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].cast("string").alias("__text"))
    rows = own.mapInArrow(send, SCHEMA)
    return exchanged(rows, n_buckets, choose, [np.uint16, np.uint64], assemble, "doc_id long, n long, key long, grams binary, prefix long, cell long")


def _block(block: int, ids: list, raws: list[bytes], width: int, n_buckets: Buckets) -> list[tuple]:
    sets = shingle_sets(raws, width)
    keys = [int((mixed(s) * (s | np.uint64(1))).sum(dtype=np.uint64) ^ np.uint64(len(s))) for s in sets]
    first, seen, at = [], set(), 0
    for s, key in zip(sets, keys, strict=True):
        first.append(-1 if key in seen else at)
        at += 0 if key in seen else len(s)
        seen.add(key)
    hashes = np.concatenate([np.zeros(0, np.uint64), *(s for s, f in zip(sets, first, strict=True) if f >= 0)])
    order = np.argsort(hashes, kind="stable")
    head_of = np.flatnonzero(np.r_[True, hashes[order][1:] != hashes[order][:-1]]) if len(order) else order
    counts = np.diff(np.r_[head_of, len(order)])
    firsts = order[head_of]
    up = np.argsort(firsts, kind="stable")
    repeated = np.repeat(firsts, counts)
    other = order != repeated
    pairs = np.stack([order[other], repeated[other]]).astype(np.uint32)
    docs = np.array([[i if i is not None else 0, i is None, len(s), k - (1 << 64) if k >> 63 else k] for i, s, k in zip(ids, sets, keys, strict=True)], np.int64)
    head = (block, n_buckets.home(block), 1, docs.tobytes(), np.array(first, np.int64).tobytes(), pairs.tobytes(), b"")
    return [head, *sent(block, hashes[firsts[up]], firsts[up], n_buckets, counts[up])]


def routes(sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(key, low, high, side): the pairs of chunks in which a set may meet a similar one; side 1 if it is of ``high``.

    ``sets`` have ``cell`` and ``sub``, which name their chunk. Rows grow with the sets' prefixes and, of a set, with
    the chunks that share them.
    """

    def spread(batches):
        for batch in (part for whole in batches for part in pieces(whole, "grams", 4 << 20)):
            grams = [np.frombuffer(g, np.int64) for g in batch.column("grams").to_pylist()]
            prefix = batch.column("prefix").to_numpy()
            rest = [np.arange(len(g), len(g) - p, -1) for g, p in zip(grams, prefix.tolist(), strict=True)]
            flat = {"gram": np.concatenate([np.zeros(0, np.int64), *(g[:p] for g, p in zip(grams, prefix.tolist(), strict=True))]), "rest": np.concatenate([np.zeros(0, np.int64), *rest]).astype(np.int32)}
            flat |= {c: np.repeat(batch.column(c).to_numpy().astype(t), prefix) for c, t in (("key", np.int64), ("n", np.int32), ("cell", np.int64), ("sub", np.int32))}
            yield pa.RecordBatch.from_pydict(flat)

    posts = sets.select("key", "n", "grams", "prefix", "cell", "sub").mapInArrow(spread, "gram long, rest int, key long, n int, cell long, sub int")
    held = posts.groupBy("gram", "cell", "sub").agg(F.count("*").alias("sets"), F.min("n").alias("least"), F.max("n").alias("most"), F.max("rest").alias("room"))
    held = held.withColumnsRenamed({"cell": "cell2", "sub": "sub2"})
    own = (F.col("cell") == F.col("cell2")) & (F.col("sub") == F.col("sub2"))
    smallest = F.greatest(F.col("least"), F.ceil(F.col("n") * percent / 100))
    overlap = F.ceil((F.col("n") + smallest) * percent / (100 + percent) - 1e-9)
    met = posts.join(held, "gram").filter((~own | (F.col("sets") > 1)) & (F.col("n") * percent <= F.col("most") * 100) & (F.col("least") * percent <= F.col("n") * 100))
    met = met.filter((F.col("rest") >= overlap) & (F.col("room") >= overlap))
    mine, theirs = F.struct("cell", "sub"), F.struct(F.col("cell2").alias("cell"), F.col("sub2").alias("sub"))
    return met.select("key", F.least(mine, theirs).alias("low"), F.greatest(mine, theirs).alias("high"), (mine > theirs).cast("int").alias("side")).distinct()


def linked(rows: pa.Table, percent: int = PERCENT) -> pa.Table:
    """Links (a, b) of keys within one group, as a forest: of one chunk with itself, or of side 0 with side 1."""
    alone = rows.column("low")[0] == rows.column("high")[0]
    rows = rows.sort_by([("side", "ascending"), ("key", "ascending")])
    keys, n = rows.column("key").to_numpy(), rows.column("n").to_numpy()
    side, prefix = rows.column("side").to_numpy(), rows.column("prefix").to_numpy()
    grams = [np.frombuffer(g, np.uint64) for g in rows.column("grams").to_pylist()]
    sizes = np.array([len(g) for g in grams])
    total, cut = len(keys), int((side == 0).sum())
    if total < 2 or (not alone and cut in (0, total)):
        return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
    doc = np.repeat(np.arange(total), sizes)
    flat, gram = np.unique(np.concatenate(grams), return_inverse=True)
    place = np.arange(len(doc)) - np.repeat(np.r_[0, np.cumsum(sizes)[:-1]], sizes)
    spot = place + np.repeat(n - sizes, sizes)  # place in the whole set's order, after its own n-grams
    # Prefix join under the length and positional filters.
    cand = np.zeros((total, total), bool)
    pick = np.flatnonzero(place < np.repeat(prefix, sizes))
    pick = pick[np.argsort(gram[pick], kind="stable")]
    edges = np.flatnonzero(np.r_[True, gram[pick][1:] != gram[pick][:-1], True]) if len(pick) else [0]
    for start, end in zip(edges[:-1], edges[1:], strict=True):
        if end - start > 1:
            mine = pick[start:end]
            d, s = doc[mine], spot[mine]
            rest = n[d] - s
            bound = np.minimum.outer(rest, rest) >= needed(n[d][:, None], n[d][None, :], percent)
            cand[np.ix_(d, d)] |= bound
    least, most = np.minimum.outer(n, n), np.maximum.outer(n, n)
    cand &= least * 100 >= most * percent
    cand &= np.arange(total)[:, None] < np.arange(total)[None, :]
    if not alone:
        cand[:cut, :cut] = cand[cut:, cut:] = False
    left, right = np.nonzero(cand)
    # Suffix filter: the overlap is at most the sum of the smaller counts over ranges of hashes.
    ranges = np.zeros((total, RANGES), np.int32)
    np.add.at(ranges, (doc, (flat[gram] >> np.uint64(59)).astype(np.int64)), 1)
    need = needed(n[left], n[right], percent)
    keep = np.concatenate([np.zeros(0, bool), *(np.minimum(ranges[left[i : i + 65536]], ranges[right[i : i + 65536]]).sum(1) >= need[i : i + 65536] for i in range(0, len(left), 65536))])
    left, right, need = left[keep], right[keep], need[keep]
    # Verification: exact overlaps from bit sets, a stretch of the n-grams at a time.
    over = np.zeros(len(left), np.int64)
    if len(left):
        stretch = 1 << 13
        for low in range(0, len(flat), stretch):
            here = np.flatnonzero((gram >= low) & (gram < low + stretch))
            bits = np.zeros((total, min(stretch, len(flat) - low)), bool)
            bits[doc[here], gram[here] - low] = True
            words = np.packbits(bits, axis=1)
            words = np.pad(words, ((0, 0), (0, -words.shape[1] % 8))).view(np.uint64)
            step = max(1, (4 << 20) // words.shape[1])
            for i in range(0, len(left), step):
                over[i : i + step] += np.bitwise_count(words[left[i : i + step]] & words[right[i : i + step]]).sum(1, dtype=np.int64)
    good = over >= need
    return forest(keys, left[good], right[good])


def classes(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The least of 0 to n - 1 that each of them reaches by the given links."""
    root = np.arange(n)
    while len(left):
        low = np.minimum(root[left], root[right])
        new = root.copy()
        np.minimum.at(new, root[left], low)
        np.minimum.at(new, root[right], low)
        new = new[new]
        while (new != new[new]).any():
            new = new[new]
        new = new[root]
        if (new == root).all():
            break
        root = new
    return root


def forest(keys: np.ndarray, left: np.ndarray, right: np.ndarray) -> pa.Table:
    """A link from each node to the least node that it reaches by the given links."""
    root = classes(len(keys), left, right)
    at = np.flatnonzero(root != np.arange(len(keys)))
    return pa.table({"a": keys[at], "b": keys[root[at]]})


def chunked(sets: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """``sets`` with ``sub``: sets of a cell with more than a chunk of sets, or of n-grams, are dealt by hash."""
    size = F.greatest(F.count("*") / chunk, F.sum(F.length("grams")) / (8 * CHUNK_GRAMS))
    large = stored(sets.groupBy("cell").agg(F.ceil(size).cast("int").alias("chunks")).filter("chunks > 1"), "cells")
    dealt = sets.join(checked(large), "cell", "left")
    return dealt.withColumn("sub", F.coalesce(F.pmod(F.xxhash64("key"), F.col("chunks")), F.lit(0)).cast("int")).drop("chunks")


def join(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", width: int = WIDTH, percent: int = PERCENT, chunk: int = CHUNK, buckets: Buckets | None = None) -> DataFrame:
    """doc_id, n_shingles and component_id: the smallest doc_id reachable by links, itself included."""
    docs = stored(shared_sets(df, text_col, id_col, width, percent, buckets), "sets")
    sets = docs.filter("prefix > 0 AND grams IS NOT NULL").groupBy("key").agg(*[F.first(c).alias(c) for c in ("n", "prefix", "grams", "cell")])
    sets = chunked(stored(sets, "distinct"), chunk)
    met = routes(sets, percent).join(sets.select("key", "n", "prefix", "grams"), "key")
    # Written, as two Python functions in one task are two workers, and Spark keeps workers with their memory.
    links = stored(met.groupBy("low", "high").applyInArrow(lambda rows: linked(rows, percent), "a long, b long"), "pairs")
    roots = components(links)
    # The least id of each set, then of each class of sets; documents meet the sets that have a class or several rows.
    keys = docs.filter("n > 0").groupBy("key").agg(F.min("doc_id").alias("least"), F.count("*").alias("rows"))
    keys = keys.join(roots, F.col("key") == F.col("node"), "left").filter("rows > 1 OR root IS NOT NULL")
    keys = stored(keys.select("key", "least", F.coalesce("root", "key").alias("root")), "keys")
    lowest = stored(keys.groupBy("root").agg(F.min("least").alias("component")), "classes")
    named = stored(keys.join(checked(lowest), "root").select("key", "component"), "named")
    out = docs.select("doc_id", "n", F.when(F.col("n") > 0, F.col("key")).alias("key")).join(checked(named), "key", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def op9(spark, sf_dir):
    """Classes of documents whose 5-word shingles overlap by three quarters or more."""
    return join(read_table(spark, sf_dir, "documents"))
