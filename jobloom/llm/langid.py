"""Language identification with hyperdimensional profiles.

Each letter has a random bipolar vector. An n-gram binds its letters: the elementwise product of the letter
vectors, each permuted (rotated) by its place. A text bundles (sums) the vectors of all its n-grams, a
language bundles those of its training texts, and a text gets the language whose prototype has the largest
cosine. Letters are lower-cased; everything else is one separator, and runs of it count once.

Bundling is linear, so a text's dot product with a prototype is the sum over its n-grams of a table that is
computed once; the norm of the text comes from its bundle, taken over its different n-grams.

Defined results: text that is null or has no letter gives ``und`` and score 0; with no labelled text every
text gives ``und``; equal cosines go to the language first by code point; columns of ``keep`` named like a result are
left out; rows are independent.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ddl, give_back, map_texts, pieces, read_table

#: Dimensions, n-gram length and codes of letters. Lower-case letters up to TABLED (all of Latin) have a code each; the
#: others share all codes by remainder, so letters of another script that lie LETTERS - 1 apart are one.
DIMENSIONS, GRAM, LETTERS, TABLED = 512, 3, 256, 0x24F
#: N-grams that a task holds before it adds them up.
HELD = 4_000_000
#: N-grams whose dot products are added up at a time, and bytes of dot products that a task remembers.
AT_ONCE, KEPT = 4096, 20 << 20
SEED = 20240607
UNDETERMINED = "und"


def letter_vectors(dimensions: int = DIMENSIONS) -> np.ndarray:
    """One bipolar vector a letter code, the same everywhere."""
    return np.random.default_rng(SEED).choice(np.array([-1.0, 1.0], np.float32), (LETTERS, dimensions))


def gram_vectors(codes: np.ndarray, letters: np.ndarray) -> np.ndarray:
    """Bound vectors of n-gram codes: the product of letter vectors rotated by their place."""
    out = np.ones((len(codes), letters.shape[1]), letters.dtype)
    rest = codes.astype(np.int64)
    for place in range(GRAM):
        out *= np.roll(letters, place, axis=1)[rest % LETTERS]
        rest = rest // LETTERS
    return out


def letter_codes() -> np.ndarray:
    """Code of every code point: 0 for all but letters, which take 1 to LETTERS - 1 by remainder."""
    points = np.arange(0x110000)
    letter = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    codes = np.where(letter, 1 + points % (LETTERS - 1), 0)
    own = [c for c in range(TABLED + 1) if chr(c).isalpha() and chr(c).lower() == chr(c)]
    codes[own] = np.arange(1, len(own) + 1)
    return codes.astype(np.uint8)


_CODES: list[np.ndarray] = []


def grams(text: str) -> np.ndarray:
    """N-gram codes of a text, in order; empty if it has no letter."""
    if not _CODES:
        _CODES.append(letter_codes())
    codes = _CODES[0][np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)]
    codes = codes[np.r_[True, (codes[1:] != 0) | (codes[:-1] != 0)]].astype(np.int64)
    if len(codes) < GRAM:
        return np.zeros(0, np.int64)
    out = codes[GRAM - 1 :].copy()
    for place in range(1, GRAM):
        out += codes[GRAM - 1 - place : len(codes) - place] * LETTERS**place
    return out


def gram_counts(df: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """(lang, gram, n) over all given rows; each task adds up its own rows before Spark adds the tasks'."""

    def run(batches):
        held: dict[str, list[np.ndarray]] = {}
        size = 0
        for part in (part for batch in batches for part in pieces(batch, "__text", 4 << 20)):
            for text, lang in zip(part.column("__text").to_pylist(), part.column("__lang").to_pylist(), strict=True):
                codes = grams(text or "")
                held.setdefault(lang, []).append(codes.astype(np.int32))
                size += len(codes)
                if size > HELD:
                    yield from _rows(held)
                    held, size = {}, 0
        yield from _rows(held)
        held = part = text = codes = None
        give_back()

    def _rows(held):
        for lang, codes in held.items():
            gram, n = np.unique(np.concatenate(codes), return_counts=True)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(gram), pa.string()), "gram": gram.astype(np.int64), "n": n})

    own = df.select(F.col(text_col).alias("__text"), F.col(lang_col).alias("__lang"))
    return own.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def fit(df: DataFrame, text_col: str = "text", lang_col: str = "lang", dimensions: int = DIMENSIONS) -> tuple[list[str], np.ndarray]:
    """Languages in order and their unit prototypes, bundled from every row that has text and a language.

    Grams are bundled in the tasks; what reaches the driver is one vector for each language.
    """
    counts = gram_counts(df.filter(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()), text_col, lang_col)

    def bundle(batches):
        letters = letter_vectors(dimensions).astype(np.float64)
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            lang = np.array(batch.column("lang").to_pylist(), object)
            codes, n = batch.column("gram").to_numpy(), batch.column("n").to_numpy().astype(np.float64)
            for name in set(lang):
                mine = np.flatnonzero(lang == name)
                for at in range(0, len(mine), 4096):
                    part = mine[at : at + 4096]
                    sums[name] = sums.get(name, 0) + n[part] @ gram_vectors(codes[part], letters)
        for name, total in sums.items():
            yield pa.RecordBatch.from_pydict({"lang": pa.array([name] * dimensions, pa.string()), "d": np.arange(dimensions), "x": total})
        give_back()

    rows = counts.mapInArrow(bundle, "lang string, d long, x double").groupBy("lang", "d").agg(F.sum("x").alias("x"))
    per = {r["lang"]: r["v"] for r in rows.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("d", "x"))).alias("v")).collect()}
    langs = sorted(per)
    protos = np.array([[v["x"] for v in per[name]] for name in langs]).reshape(len(langs), dimensions)
    norms = np.linalg.norm(protos, axis=1, keepdims=True) if langs else np.ones((0, 1))
    return langs, protos / np.where(norms == 0, 1, norms)


class Model:
    """Prototypes with the per-gram tables that a worker builds once."""

    def __init__(self, langs: list[str], protos: np.ndarray):
        self.langs, self.letters = langs, letter_vectors(protos.shape[1]).astype(np.int8)
        self.protos = protos.astype(np.float32)
        self.rows = np.zeros((0, protos.shape[1]), np.int8)
        self._empty()

    def _empty(self) -> None:
        """No gram has a row. A gram's place is in the page of its first two letters, which is made when such a gram is first met."""
        self.page = np.zeros(LETTERS ** (GRAM - 1), np.int32)
        self.place = np.full((1, LETTERS), -1, np.int32)  # page 0 stays empty
        self.size = 0

    def _places(self, codes: np.ndarray) -> np.ndarray:
        head = codes // LETTERS
        return self.place[self.page[head], codes - head * LETTERS]

    def lookup(self, codes: np.ndarray) -> np.ndarray:
        """Rows of the gram vectors, bound when a gram is first met; the table is emptied when it grows large."""
        at = self._places(codes)
        if (new := codes[at < 0]).size:
            if self.size + len(new) > 40_000:
                self._empty()
                new = codes
            if self.size + len(new) > len(self.rows):
                grown = np.zeros((max(2 * len(self.rows), self.size + len(new), 4096), self.protos.shape[1]), np.int8)
                grown[: self.size] = self.rows[: self.size]
                self.rows = grown
            self.rows[self.size : self.size + len(new)] = gram_vectors(new, self.letters)
            heads = np.unique(new // LETTERS)
            if (heads := heads[self.page[heads] == 0]).size:
                self.page[heads] = len(self.place) + np.arange(len(heads))
                self.place = np.vstack([self.place, np.full((len(heads), LETTERS), -1, np.int32)])
            self.place[self.page[new // LETTERS], new % LETTERS] = np.arange(self.size, self.size + len(new))
            self.size += len(new)
            at = self._places(codes)
        return self.rows[at]

    def cosines(self, text: str) -> np.ndarray | None:
        codes = grams(text)
        if not len(codes) or not self.langs:
            return None
        codes = np.sort(codes)
        first = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
        n = np.diff(np.r_[first, len(codes)]).astype(np.float32)
        bundle = np.zeros(self.protos.shape[1], np.float64)
        for at in range(0, len(first), 2048):
            bundle += n[at : at + 2048] @ self.lookup(codes[first[at : at + 2048]]).astype(np.float32)
        norm = np.linalg.norm(bundle)
        return (self.protos @ bundle.astype(np.float32)) / norm if norm else np.zeros(len(self.langs))


class Teller:
    """The language whose prototype has the largest cosine, without the cosine.

    A text's norm is the same for all languages, so a text's dot products decide: sums of its grams' dot products, which
    are worked out when a gram is first met. A gram takes one number a language instead of a vector.
    """

    def __init__(self, langs: list[str], protos: np.ndarray):
        self.langs, self.protos = langs, np.asarray(protos, np.float64)
        letters = letter_vectors(protos.shape[1])
        self.rolled = [np.roll(letters, place, axis=1) for place in range(GRAM)]  # once, as most texts bring few new grams
        self.place = np.full(LETTERS**GRAM, -1, np.int32)
        self.most = max(AT_ONCE, KEPT // max(1, 8 * len(langs)))
        self.dots, self.size = np.zeros((0, len(langs))), 0

    def _learn(self, codes: np.ndarray) -> None:
        """Dot products of the grams of ``codes`` that have none; the table is emptied when it grows large."""
        new = np.unique(codes[self.place[codes] < 0])
        if self.size + len(new) > self.most:
            self.place[:] = -1
            self.size, new = 0, np.unique(codes)
        if self.size + len(new) > len(self.dots):
            grown = np.zeros((min(self.most, max(2 * len(self.dots), self.size + len(new), AT_ONCE)), len(self.langs)))
            grown[: self.size] = self.dots[: self.size]
            self.dots = grown
        vectors = np.prod([of[new // LETTERS**place % LETTERS] for place, of in enumerate(self.rolled)], axis=0)
        self.dots[self.size : self.size + len(new)] = vectors.astype(np.float64) @ self.protos.T
        self.place[new] = np.arange(self.size, self.size + len(new))
        self.size += len(new)

    def language(self, text: str) -> str:
        codes = grams(text)
        if not len(codes) or not self.langs:
            return UNDETERMINED
        total = np.zeros(len(self.langs))
        for at in range(0, len(codes), AT_ONCE):
            part = codes[at : at + AT_ONCE]
            places = self.place[part]
            if places.min() < 0:
                self._learn(part)
                places = self.place[part]
            total += np.ones(len(places)) @ self.dots.take(places, axis=0)
        return self.langs[int(np.argmax(total))]


_MODELS: dict[bytes, Model] = {}


def _loaded(key: bytes, langs: list[str], protos: np.ndarray) -> Model:
    if key not in _MODELS:
        _MODELS.clear()
        _MODELS[key] = Model(langs, protos)
    return _MODELS[key]


def forget() -> None:
    """Lets go of the model, which a worker that lives on would hold through all later tasks."""
    _MODELS.clear()


def predict(df: DataFrame, model: tuple[list[str], np.ndarray], text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, ``lang_pred`` and ``score``: the best cosine, 0 where it is negative."""
    langs, protos = model
    key = hashlib.sha256(repr((langs, protos.shape)).encode() + protos.tobytes()).digest()
    keep = tuple(k for k in keep if k not in ("lang_pred", "score"))
    name = text_col if text_col in keep and df.schema[text_col].dataType.simpleString() == "string" else "__text"

    def run(batch: pa.RecordBatch) -> dict:
        own, names, scores = _loaded(key, langs, protos), [], []
        for text in batch.column(name).to_pylist():
            cos = own.cosines(text or "")
            best = -1 if cos is None else int(np.argmax(cos))
            names.append(UNDETERMINED if cos is None else langs[best])
            scores.append(0.0 if cos is None else round(float(min(1.0, max(0.0, cos[best]))), 6))
        return {k: batch.column(k) for k in keep} | {"lang_pred": pa.array(names, pa.string()), "score": pa.array(scores, pa.float64())}

    own = df.select(*keep) if name in keep else df.select(*keep, df[text_col].cast("string").alias(name))
    return map_texts(own, run, ddl(own) + "lang_pred string, score double", name, after=forget)


def is_held_out(id_col: str = "doc_id") -> F.Column:
    return F.crc32(F.col(id_col).cast("string")) % 4 == 2


def op1(spark, sf_dir):
    """Predictions for all documents, learnt from those that are not held out."""
    docs = read_table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    model = fit(docs.filter(F.coalesce(~is_held_out(), F.lit(True))))
    own = docs.select("doc_id", F.coalesce(is_held_out(), F.lit(False)).alias("held_out"), "text")
    return predict(own, model, keep=("doc_id", "held_out"))
