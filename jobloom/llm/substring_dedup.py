"""Substring deduplication: Rabin-Karp hashes of every window of words, counted in Spark.

Every window of ``width`` consecutive words is hashed from prefix sums, all hashes are counted over the corpus
(see ``packed``), and the windows that occur more than once merge into maximal intervals of words to remove.
Windows are judged on the input, so every occurrence of a repeated passage goes.

Defined results: null text has no words; texts shorter than the window keep all words; rows that agree in id and
text have the same windows, which repeat each other; an empty table gives an empty table.
Hashes have 64 bits: among n different windows about n**2 / 2**65 pairs are expected to meet by chance.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLOCK_WORDS, give_back, map_texts, read_table, rolling, utf8, word_hashes
from .packed import SCHEMA, Answers, Bucket, Buckets, block_number, exchanged, packed_gaps, sent, table, unpacked_gaps

WIDTH = 35


def _keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    both = (df[id_col], df[text_col])
    return df.select(df[id_col].alias("doc_id"), df[text_col].alias("__text"), F.xxhash64(F.lit(1), *both).alias("k1"), F.xxhash64(F.lit(2), *both).alias("k2"))


def removals(df: DataFrame, width: int = WIDTH, buckets: Buckets | None = None) -> DataFrame:
    """(k1, k2, spans) of the keyed rows that lose words: spans are [first, last) word numbers, ascending."""
    n = buckets or Buckets.of(df)

    def send(batches):
        count = 0
        for batch in batches:
            words, docs, rows = [], [], []
            keys = np.stack([batch.column("k1").to_numpy(), batch.column("k2").to_numpy()]).T
            for key, raw in zip(keys, utf8(batch.column("__text")), strict=True):
                mine = raw.split()
                if len(mine) < width:
                    continue
                if words and len(words) + len(mine) > BLOCK_WORDS:
                    yield table(_block(block_number(count), words, docs, rows, width, n))
                    words, docs, rows, count = [], [], [], count + 1
                docs.append(len(words))
                rows.append(key)
                words += mine
            if words:
                yield table(_block(block_number(count), words, docs, rows, width, n))
                count += 1
            give_back()

    def choose(own: Bucket) -> tuple:
        return own.totals() > 1, []

    def assemble(head: dict, told: Answers) -> pa.Table:
        at = np.unique(np.r_[unpacked_gaps(head["c"]), told.places])
        keys, starts = np.frombuffer(head["a"], np.int64).reshape(-1, 2), np.frombuffer(head["b"], np.int64)
        doc = np.searchsorted(starts, at, "right") - 1
        new = np.flatnonzero(np.r_[True, (at[1:] > at[:-1] + width) | (doc[1:] != doc[:-1])]) if len(at) else np.zeros(0, np.int64)
        last = np.r_[new[1:] - 1, len(at) - 1] if len(at) else new
        spans = np.stack([at[new] - starts[doc[new]], at[last] + width - starts[doc[new]]]).T.astype(np.int32)
        of = doc[new]
        edge = np.flatnonzero(np.r_[True, of[1:] != of[:-1]]) if len(of) else of
        parts = np.split(spans, edge[1:]) if len(of) else []
        return pa.table({"k1": keys[of[edge], 0], "k2": keys[of[edge], 1], "spans": pa.array([p.tobytes() for p in parts], pa.binary())})

    rows = df.select("k1", "k2", "__text").filter(F.col("__text").isNotNull()).mapInArrow(send, SCHEMA)
    found = exchanged(rows, n, choose, [], assemble, "k1 long, k2 long, spans binary")
    return found.groupBy("k1", "k2").agg(F.max("spans").alias("spans"))  # rows that agree in id and text


def _block(block: int, words: list[bytes], docs: list[int], keys: list[np.ndarray], width: int, n: Buckets) -> list[tuple]:
    """Rows of one block: all windows, of a hash the first two, and the directory with the others' places."""
    starts = np.array(docs, np.int64)
    hashes = rolling(word_hashes(words), width)
    ends = np.r_[starts[1:], len(words)] - width + 1
    valid = np.zeros(len(words) + 1, np.int32)  # a window lies within one document
    np.add.at(valid, starts, 1)
    np.add.at(valid, ends, -1)
    places = np.flatnonzero(np.cumsum(valid[:-1])[: len(hashes)] > 0)
    hashes = hashes[places]
    order = np.argsort(hashes, kind="stable")
    same = np.r_[False, hashes[order][1:] == hashes[order][:-1]]
    third = np.zeros(len(hashes), bool)
    third[order] = same & np.r_[False, same[:-1]]
    head = (block, n.home(block), 1, np.array(keys, np.int64).tobytes(), starts.tobytes(), packed_gaps(places[third]), b"")
    return [head, *sent(block, hashes[~third], places[~third], n)]


def dedup(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", width: int = WIDTH, buckets: Buckets | None = None) -> DataFrame:
    """doc_id, ``n_words``, ``spans`` array of removed [first, last) word numbers, ``kept`` text of every row."""
    return _applied(df, text_col, id_col, width, lambda words, spans: {"kept": b" ".join(_kept(words, spans)).decode()}, "kept string", buckets)


def _kept(words: list[bytes], spans: np.ndarray) -> list[bytes]:
    out, at = [], 0
    for first, last in spans:
        out += words[at:first]
        at = last
    return out + words[at:]


def _applied(df: DataFrame, text_col: str, id_col: str, width: int, fn, schema: str, buckets: Buckets | None = None) -> DataFrame:
    own = _keyed(df, id_col, text_col)
    gone = removals(own, width, buckets)
    both = own.join(gone, ["k1", "k2"], "left").select("doc_id", "__text", "spans")
    kind = own.schema["doc_id"].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> dict:
        n_words, removed, spans, more = [], [], [], []
        for raw, mine in zip(utf8(batch.column("__text")), batch.column("spans").to_pylist(), strict=True):
            words = raw.split()
            at = np.frombuffer(mine or b"", np.int32).reshape(-1, 2)
            n_words.append(len(words))
            removed.append(int((at[:, 1] - at[:, 0]).sum()))
            spans.append(at.tolist())
            more.append(fn(words, at))
        out = {"doc_id": batch.column("doc_id"), "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "spans": pa.array(spans, pa.list_(pa.list_(pa.int32())))}
        return out | {k: pa.array([m[k] for m in more], pa.string()) for k in (x.split()[0] for x in schema.split(", "))}

    return map_texts(both, run, f"doc_id {kind}, n_words long, n_removed long, spans array<array<int>>, {schema}", "__text")


def op4(spark, sf_dir):
    """Words removed from every document and the digest of what is kept."""
    docs = read_table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    digest = lambda words, spans: {"kept_sha256": hashlib.sha256(b" ".join(_kept(words, spans))).hexdigest()}
    return _applied(docs, "text", "doc_id", WIDTH, digest, "kept_sha256 string").drop("spans")
