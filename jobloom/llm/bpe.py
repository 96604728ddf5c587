"""Byte-level BPE encoding and decoding with the ``tokenizers`` library over Arrow batches.

Texts are split by the pattern; the library encodes each different piece of a worker once, and a text's ids
are the pieces' ids in order, which is what encoding each match separately means. Pieces pass to the library
in the byte-to-character alphabet, in which every byte is one printable character.

Defined results: null text is the empty text (no ids, empty bytes); rows are independent, so repeated rows
give repeated results; a token that holds part of a character has the offsets of that whole character; columns of
``keep`` named like a result are left out.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
import unicodedata
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import ddl, map_texts, read_table

#: Pieces a worker remembers; beyond it the memory is emptied, which changes speed only.
MEMORY = 100_000
#: Bytes of text encoded at a time.
SLICE = 1 << 20
#: The public pattern in the terms of Python's own faster matcher. The two agree on texts without the
#: characters that ``Codec.odd`` finds; other texts, and other patterns, take the exact matcher.
PLAIN = r"'(?:s|t|re|ve|m|ll|d)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+"
PLAIN_FOR = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_alphabet() -> list[str]:
    """The character of each byte: itself where printable, else the next one from 256 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in own else next(spare)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a rank file: base64 and a number on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Codec:
    """Encoder and decoder of one rank table. Built once in each Python worker."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark gives a task one core
        import regex
        from tokenizers import Tokenizer, models

        plain = pattern == PLAIN_FOR
        # White space is the Unicode property, as in the rank files' own library; Python's \s has four more.
        pattern = pattern.replace(r"(?!\S)", r"(?!\P{White_Space})").replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}")
        self.exact = regex.compile(pattern).findall
        self.plain = re.compile(PLAIN).findall if plain else None
        odd = "".join(chr(c) for c in range(0x10000) if unicodedata.category(chr(c)) in ("Nl", "No"))
        self.odd = (re.compile(f"[\x1c-\x1f{odd}]").search, re.compile("[\U00010000-\U0010ffff]").search)
        self.alphabet = byte_alphabet()
        self.to_chars = {b: c for b, c in enumerate(self.alphabet)}
        self.to_bytes = {c: b for b, c in enumerate(self.alphabet)}
        spell = self.spell
        merges = [
            (spell(token[:i]), spell(token[i:]))
            for token, _ in sorted(ranks.items(), key=lambda x: x[1])
            for i in range(1, len(token))
            if token[:i] in ranks and token[i:] in ranks
        ]
        vocab = {spell(token): rank for token, rank in ranks.items()}
        self.model = Tokenizer(models.BPE(vocab=vocab, merges=merges, ignore_merges=True, cache_capacity=0))
        self.token_bytes = [b""] * (max(ranks.values(), default=-1) + 1)
        for chars, rank in vocab.items():
            self.token_bytes[rank] = bytes(map(self.to_bytes.__getitem__, chars))
        self.known: dict[str, bytes] = {}

    def spell(self, raw: bytes) -> str:
        return raw.decode("latin-1").translate(self.to_chars)

    def split(self, text: str) -> list[str]:
        return self.exact(text) if self.plain is None or any(find(text) for find in self.odd) else self.plain(text)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit numbers."""
        split = [self.split(t) for t in texts]
        if len(self.known) > MEMORY:
            self.known.clear()
        new = [p for p in set(chain.from_iterable(split)) if p not in self.known]
        for at in range(0, len(new), 1024):
            part = new[at : at + 1024]
            for piece, enc in zip(part, self.model.encode_batch_fast([self.spell(p.encode()) for p in part], add_special_tokens=False), strict=True):
                self.known[piece] = np.array(enc.ids, "<u4").tobytes()
        return [b"".join(map(self.known.__getitem__, s)) for s in split]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.token_bytes.__getitem__, np.frombuffer(ids, "<u4").tolist()))

    def offsets(self, ids: bytes) -> tuple[np.ndarray, np.ndarray]:
        """First character and character after the last of each token, in code points."""
        numbers = np.frombuffer(ids, "<u4").tolist()
        ends = np.cumsum([0] + [len(self.token_bytes[i]) for i in numbers])
        raw = np.frombuffer(self.decode(ids), np.uint8)
        char = np.r_[np.cumsum((raw & 0xC0) != 0x80) - 1, 0].astype(np.int64)
        if not len(raw):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return char[ends[:-1]], char[ends[1:] - 1] + 1


_CODECS: dict[str, Codec] = {}


def codec(source: Source) -> Codec:
    """The worker's codec of a rank table, known by the table's digest."""
    if source.key not in _CODECS:
        _CODECS.clear()
        _CODECS[source.key] = Codec(source.ranks, source.pattern)
    return _CODECS[source.key]


def forget() -> None:
    """Empties the memory of pieces: a worker that lives on holds the table alone."""
    for own in _CODECS.values():
        own.known.clear()


class Source(NamedTuple):
    """A rank table as tasks get it: Spark broadcasts functions of this size once to each executor."""

    key: str
    ranks: dict[bytes, int]
    pattern: str


def _source(path: str | None, pattern: str | None) -> Source:
    if path is None or pattern is None:
        import public_tokenizers

        path = path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
        pattern = pattern or public_tokenizers.PATTERN
    with open(path, "rb") as lines:
        key = hashlib.sha256(lines.read() + pattern.encode()).hexdigest()
    return Source(key, read_ranks(path), pattern)


def encode(df: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), path: str | None = None, pattern: str | None = None) -> DataFrame:
    """``keep`` columns, ``ids`` array<int> and ``starts``, ``ends`` array<int>, each token's code points."""
    source = _source(path, pattern)
    keep = tuple(k for k in keep if k not in ("ids", "starts", "ends"))

    def run(batch: pa.RecordBatch) -> dict:
        own = codec(source)
        ids = own.encode([t or "" for t in batch.column("__text").to_pylist()])
        spans = [own.offsets(x) for x in ids]
        ints = pa.list_(pa.int32())
        return {k: batch.column(k) for k in keep} | {
            "ids": pa.array([np.frombuffer(x, "<i4") for x in ids], ints),
            "starts": pa.array([s.astype(np.int32) for s, _ in spans], ints),
            "ends": pa.array([e.astype(np.int32) for _, e in spans], ints),
        }

    own = df.select(*keep, df[text_col].cast("string").alias("__text"))
    kinds = ddl(own)
    return map_texts(own, run, kinds + "ids array<int>, starts array<int>, ends array<int>", "__text", SLICE, forget)


def decode(df: DataFrame, ids_col: str = "ids", keep: tuple[str, ...] = ("doc_id",), path: str | None = None, pattern: str | None = None) -> DataFrame:
    """``keep`` columns and ``decoded`` binary: the bytes of the ids; null ids give empty bytes."""
    source = _source(path, pattern)
    keep = tuple(k for k in keep if k != "decoded")

    def run(batches):
        own = codec(source)
        for batch in batches:
            raw = [own.decode(np.array(x or [], "<u4").tobytes()) for x in batch.column("__ids").to_pylist()]
            yield pa.RecordBatch.from_pydict({k: batch.column(k) for k in keep} | {"decoded": pa.array(raw, pa.binary())})

    own = df.select(*keep, df[ids_col].alias("__ids"))
    kinds = ddl(own, "__ids")
    return own.mapInArrow(run, kinds + "decoded binary")


def digest(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every text, encoded and decoded again in one pass."""
    source = _source(path, pattern)

    def run(batch: pa.RecordBatch) -> dict:
        own = codec(source)
        ids = own.encode([t or "" for t in batch.column("__text").to_pylist()])
        return {
            "doc_id": batch.column("doc_id"),
            "n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64()),
            "ids_sha256": [hashlib.sha256(x).hexdigest() for x in ids],
            "decoded_sha256": [hashlib.sha256(own.decode(x)).hexdigest() for x in ids],
        }

    own = df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].cast("string").alias("__text"))
    return map_texts(own, run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", "__text", SLICE, forget)


def op10(spark, sf_dir):
    return digest(read_table(spark, sf_dir, "documents"))
