"""Toxicity by a convolutional text classifier over hashed word embeddings, trained here in numpy.

A word's vector is the sum of table rows for the hashes of the word and of its character n-grams, so unseen forms of a
word resemble those seen. Filters of several widths pass over a text's words; each filter's largest response in the text
is kept (max pooling), and a logistic layer weighs these. Training is by small batches with adagrad; gradients reach only
the words at which a filter is largest.

The classifier learns from whole texts of all labelled rows. A first network, trained in one task on a bounded sample
(about ``ROWS`` rows of up to ``CHARS`` characters, up to ``WORDS`` words in all, both labels alike as far as they go), is
only where learning starts. From there the rows lie in shards of about ``SHARD``; each shard's task goes on from the first
network over its own rows, weighted so that both labels count alike, and the network is the mean of what the shards have
changed, for a row of the table the mean of the shards that changed it.

A fifth of all labelled rows is kept from training and calibrates the thresholds: for each language the logit, in steps of
1 / ``STEPS``, that tells its calibration rows apart best. A text's language is told from the text alone by ``langid``,
learnt on all labelled rows; a language with few toxic calibration rows takes the threshold of all. Scores are shifted so
that a language's threshold has score ``CUT``.

Scoring is a map over whole texts, long ones in slices of words that overlap by the widest filter.

Defined results: null text is empty; a text without words has no response of any filter and gets the score of the bias;
without rows of both labels all scores are 0; labels of repeated ids count as toxic if one says so; rows without a label
or an id teach nothing; other columns, whatever their names, take no part.
"""

from __future__ import annotations

import hashlib
import math
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import langid
from .common import checked, ddl, give_back, map_texts, mixed, pieces, read_table, stored, word_hashes

#: Size of vectors, rows of the table, widths of filters, filters of each width, lengths of character n-grams.
SIZE, TABLE, WIDTHS, FILTERS, GRAMS = 16, 1 << 17, (1, 2, 3), 16, (3, 4, 5)
#: Bounds of the sample of the first network: rows, characters of a row, words in all.
ROWS, CHARS, WORDS = 8_000, 100_000, 10_000_000
#: Texts that training visits, in at most so many passes; texts of a batch, step of adagrad, weight decay of the last layer.
VISITS, PASSES, BATCH, STEP, DECAY = 32_000, 15, 32, 0.05, 1e-4
#: Score at the threshold, and toxic calibration rows below which a language has no threshold of its own.
CUT, FEW = 0.7, 12
#: Rows of a shard, words that a shard holds at a time, its part of the step, rows of the table that are added up at a
#: time, and rows below which shards make several passes.
SHARD, CHUNK, GOES_ON, SLAB, AGAIN = 5_000, 300_000, 0.5, 64, 8_000
#: Steps of a logit at which thresholds may lie, places of a text whose responses are held at a time, and places whose
#: responses are added up at a time, few enough to stay in a core's cache.
STEPS, PLACES, NEAR = 256, 200_000, 2048
#: Words whose vectors a scoring task remembers.
KNOWN = 200_000
SEED = 20240711
#: Characters of a text that are split at a time, and code points whose n-grams are held at a time.
SLICE, HELD = 1 << 20, 200_000

_GAPS = bytes(32 if i < 128 and not chr(i).isalnum() else i for i in range(256))


def words(text: str, most: int = SLICE) -> Iterator[list[str]]:
    """Lower-case words without ASCII punctuation; a long text comes in several lists, cut between words."""
    start = 0
    while start < len(text):
        end = start + most
        while end < len(text) and text[end].isalnum():
            end += 1
        yield text[start:end].lower().encode("utf-8", "surrogatepass").translate(_GAPS).decode("utf-8", "surrogatepass").split()
        start = end


def features(unique: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Table rows of each word and its character n-grams, word after word, and how many each word has."""
    lengths = np.fromiter(map(len, unique), np.int64, len(unique)) + 2
    points = np.frombuffer("".join(f"<{w}>" for w in unique).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    ends = np.cumsum(lengths)
    owner = np.repeat(np.arange(len(unique)), lengths)
    found, of = [word_hashes([w.encode("utf-8", "surrogatepass") for w in unique])], [np.arange(len(unique))]
    for n in GRAMS:
        at = np.arange(max(0, len(points) - n + 1))
        at = at[at + n <= ends[owner[at]]]
        value = np.full(len(at), n, np.uint64)
        for k in range(n):
            value = value * np.uint64(0x100000001B3) + points[at + k]
        found.append(mixed(value))
        of.append(owner[at])
    of = np.concatenate(of)
    order = np.argsort(of, kind="stable")
    return (np.concatenate(found)[order] % np.uint64(TABLE)).astype(np.int32), np.bincount(of, minlength=len(unique))


class Network:
    """Table of vectors, filters by width and place, their biases, and the last layer."""

    def __init__(self, seed: int = SEED):
        rng = np.random.default_rng(seed)
        draw = lambda *shape, by: (rng.standard_normal(shape) * by).astype(np.float32)
        self.table = draw(TABLE, SIZE, by=0.1)
        self.filters = {w: draw(w, SIZE, FILTERS, by=(1 / (w * SIZE)) ** 0.5) for w in WIDTHS}
        self.bias = np.zeros(FILTERS * len(WIDTHS), np.float32)
        self.last = draw(FILTERS * len(WIDTHS), by=0.3)
        self.constant = np.float32(0)
        self.known: dict[str, int] = {}

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("known", "kept")} | {"known": {}}

    def of_words(self, unique: list[str]) -> np.ndarray:
        """``vectors`` of different words, remembered from call to call while they are few."""
        if len(self.known) + len(unique) > KNOWN or not self.known:
            self.known, self.kept = {}, np.zeros((0, SIZE), np.float32)
        new = [w for w in unique if w not in self.known]
        if new:
            found, at = [self.kept], 0
            cut = np.cumsum([len(w) + 2 for w in new]) // HELD
            for end in np.flatnonzero(np.diff(cut, append=-1)) + 1:
                found.append(self.vectors(*features(new[at:end]))[1:])
                at = end
            self.known.update(zip(new, range(len(self.kept), len(self.kept) + len(new)), strict=True))
            self.kept = np.concatenate(found)
        at = np.fromiter(map(self.known.__getitem__, unique), np.int64, len(unique))
        out = np.zeros((len(at) + 1, SIZE), np.float32)
        out[1:] = self.kept.take(at, axis=0)
        return out

    def vectors(self, rows: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Vectors of words; the first row is the empty place between texts."""
        out = np.zeros((len(sizes) + 1, SIZE), np.float32)
        if len(sizes):
            np.add.reduceat(self.table.take(rows, axis=0), np.r_[0, np.cumsum(sizes)[:-1]], axis=0, out=out[1:])
            out[1:] /= np.sqrt(sizes)[:, None]
        return out

    def responses(self, vectors: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Responses of all filters at every place of ``codes``; texts end in places of code 0, as many as the widest filter less one."""
        padded = np.r_[codes, np.zeros(max(WIDTHS), codes.dtype)]
        by_place = [np.concatenate([vectors @ self.filters[w][k] for w in WIDTHS if w > k], axis=1) for k in range(max(WIDTHS))]
        out = np.empty((len(codes), FILTERS * len(WIDTHS)), np.float32)
        for at in range(0, len(codes), NEAR):
            own = out[at : at + NEAR]
            np.take(by_place[0], codes[at : at + NEAR], axis=0, out=own, mode="clip")
            for k in range(1, max(WIDTHS)):
                own[:, FILTERS * sum(w <= k for w in WIDTHS) :] += by_place[k].take(padded[at + k : at + k + len(own)], axis=0)
        out[codes == 0] = -np.inf
        return out

    def logits(self, most: np.ndarray) -> np.ndarray:
        return np.maximum(most + self.bias, 0) @ self.last + self.constant


GAP = max(WIDTHS) - 1


def laid(codes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Texts' codes in one row, each followed by gaps, and where each starts."""
    starts = np.r_[0, np.cumsum([len(c) + GAP for c in codes])[:-1]].astype(np.int64)
    out = np.zeros(sum(map(len, codes)) + GAP * len(codes), np.int64)
    for at, c in zip(starts, codes, strict=True):
        out[at : at + len(c)] = c
    return out, starts


def largest(net: Network, vectors: np.ndarray, line: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's largest response of each filter and its first place; long lines go in slices, so texts may be of any length."""
    ends = np.r_[starts[1:], len(line)]
    most, top = np.full((len(starts), len(net.bias)), -np.inf, np.float32), np.repeat(starts[:, None], len(net.bias), axis=1)
    whole = net.responses(vectors, line) if len(line) <= PLACES else None
    for i, (begin, end) in enumerate(zip(starts, ends, strict=True)):
        for at in range(begin, end, PLACES):
            upto = min(at + PLACES, end)
            places = whole[at:upto] if whole is not None else net.responses(vectors, line[at : upto + GAP])[: upto - at]
            place = places.argmax(0)
            value = np.take_along_axis(places, place[None], 0)[0]
            more = value > most[i]
            most[i, more], top[i, more] = value[more], at + place[more]
    return most, top


class Learner:
    """A network in training: adagrad by small batches, with the squares of the gradients so far."""

    def __init__(self):
        self.net = net = Network()
        self.seen = {k: np.full_like(v, 1e-2) for k, v in (("bias", net.bias), ("last", net.last), *net.filters.items())}
        self.seen_table, self.seen_constant = np.full(TABLE, 1e-3, np.float32), 1e-2

    def dense(self) -> list[np.ndarray]:
        """All parameters but the table and the constant."""
        return [self.net.bias, self.net.last, *self.net.filters.values()]

    def learn(self, texts: list[list[str]], toxic: np.ndarray, weights: np.ndarray, steps: list[float], rng: np.random.Generator) -> None:
        """Passes over texts as lists of words, one for each of ``steps``."""
        flat = np.empty(sum(map(len, texts)), object)
        flat[:] = [w for t in texts for w in t]
        codes, unique = pd.factorize(flat)
        parts = np.split(codes + 1, np.cumsum([len(t) for t in texts])[:-1])
        rows, sizes = features(unique.tolist())
        first = np.r_[0, np.cumsum(sizes)]
        for step in steps:
            order = rng.permutation(len(texts))
            for at in range(0, len(order), BATCH):
                mine = order[at : at + BATCH]
                self._batch([parts[i] for i in mine], toxic[mine], weights[mine], step, rows, sizes, first)

    def _batch(self, codes, toxic, weights, step, rows, sizes, first) -> None:
        net, seen, of = self.net, self.seen, np.repeat(np.arange(len(WIDTHS)), FILTERS)
        line, starts = laid(codes)
        used, local = np.unique(line[line > 0], return_inverse=True)
        line[line > 0] = local + 1
        counts = sizes[used - 1]
        own = rows[np.repeat(first[used - 1] - np.r_[0, np.cumsum(counts)[:-1]], counts) + np.arange(counts.sum())] if len(used) else rows[:0]
        vectors = net.vectors(own, counts)
        most, top = largest(net, vectors, line, starts)
        hidden = np.maximum(most + net.bias, 0)
        error = (1 / (1 + np.exp(-np.clip(hidden @ net.last + net.constant, -30, 30))) - toxic) * weights / len(codes)
        back = (error[:, None] * net.last) * (hidden > 0)
        text, filt = np.nonzero(back)
        grads = {"bias": back.sum(0), "last": hidden.T @ error + DECAY * net.last} | {w: np.zeros_like(f) for w, f in net.filters.items()}
        to_word = np.zeros_like(vectors)
        padded = np.r_[line, np.zeros(max(WIDTHS), np.int64)]
        for i, width in enumerate(WIDTHS):
            here = of[filt] == i
            f, value, place = filt[here] - i * FILTERS, back[text[here], filt[here]].astype(np.float32), top[text[here], filt[here]]
            for k in range(width):
                word = padded[place + k]
                np.add.at(grads[width][k].T, f, value[:, None] * vectors[word])
                np.add.at(to_word, word, value[:, None] * net.filters[width][k].T[f])
        for name, value, grad in (("bias", net.bias, grads["bias"]), ("last", net.last, grads["last"]), *((w, net.filters[w], grads[w]) for w in WIDTHS)):
            seen[name] += grad * grad
            value -= step * grad / np.sqrt(seen[name])
        self.seen_constant += float(error.sum()) ** 2
        net.constant -= np.float32(step * error.sum() / self.seen_constant**0.5)
        touched = np.flatnonzero(to_word[1:].any(1))
        if len(touched):
            many = counts[touched]
            begin = np.r_[0, np.cumsum(counts)[:-1]][touched]
            index = own[np.repeat(begin - np.r_[0, np.cumsum(many)[:-1]], many) + np.arange(many.sum())]
            grad = np.repeat(to_word[1:][touched] / np.sqrt(many)[:, None], many, axis=0)
            sort = np.argsort(index, kind="stable")
            edge = np.flatnonzero(np.r_[True, np.diff(index[sort]) > 0])
            total, index = np.add.reduceat(grad[sort], edge, axis=0), index[sort][edge]
            self.seen_table[index] += (total * total).mean(1)
            net.table[index] -= step * total / np.sqrt(self.seen_table[index])[:, None]


def train(texts: list[list[str]], toxic: np.ndarray, visits: int = VISITS) -> Learner:
    """A network that has learnt from texts as lists of words."""
    passes = max(1, min(PASSES, visits // max(1, len(texts))))
    learner = Learner()
    learner.learn(texts, toxic, np.ones(len(texts), np.float32), [STEP * (1 - turn / (passes + 1)) for turn in range(passes)], np.random.default_rng(SEED))
    return learner


def score_words(net: Network, texts: list[Iterator[list[str]]], hold: int = 200_000) -> np.ndarray:
    """Logit of each text, given as lists of its words in order."""
    out = np.full((len(texts), len(net.bias)), -np.inf, np.float32)
    held, owners, more, size = [], [], [], 0

    def settle():
        flat = np.empty(size, object)
        flat[:] = [w for part in held for w in part]
        codes, unique = pd.factorize(flat)
        vectors = net.of_words(unique.tolist())
        line, starts = laid(np.split(codes + 1, np.cumsum([len(p) for p in held])[:-1]))
        places = net.responses(vectors, line)
        for start, part, goes_on, i in zip(starts, held, more, owners, strict=True):
            # the last words of a slice stand at the head of the next one again, with what follows them
            end = start + max(0, len(part) - GAP if goes_on else len(part))
            if end > start:
                np.maximum(out[i], places[start:end].max(axis=0), out=out[i])

    for i, parts in enumerate(texts):
        part = next(parts, None)
        while part is not None:
            after = next(parts, None)
            held.append(part)
            owners.append(i)
            more.append(after is not None)
            size += len(part)
            part = after if after is None else part[-GAP:] + after
            if size > hold:
                settle()
                held, owners, more, size = [], [], [], 0
    if held:
        settle()
    return net.logits(out)


def threshold(logits: np.ndarray, toxic: np.ndarray, weights: np.ndarray) -> float:
    """The middle of the gap at which the weighted F1 is largest."""
    order = np.argsort(-logits, kind="stable")
    value, good = logits[order], weights[order] * toxic[order]
    f1 = 2 * np.cumsum(good) / (np.cumsum(weights[order]) + good.sum())
    f1[np.r_[value[1:] == value[:-1], False]] = -1
    best = int(np.argmax(f1))
    return float(value[best] + value[best + 1]) / 2 if best + 1 < len(value) else float(value[best]) - 1


def _labels(labels: DataFrame) -> DataFrame:
    """(doc_id, toxic) of labels that teach: one a document, toxic if one says so."""
    return labels.select("doc_id", "toxic").filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).filter("toxic IN (0, 1)")


def _sizes(own: DataFrame) -> dict[int, int]:
    return {r["toxic"]: r["n"] for r in own.groupBy("toxic").agg(F.count("*").alias("n")).collect()}


def sample(docs: DataFrame, labels: DataFrame, rows: int = ROWS, chars: int = CHARS) -> DataFrame:
    """(text, lang, toxic, weight, draw) of about ``rows`` labelled rows, half of them toxic as far as they go."""
    own = _labels(labels)
    sizes = _sizes(own)
    quota = {k: rows / 2 + max(0, rows / 2 - sizes.get(1 - k, 0)) for k in (0, 1)}
    rates = {k: min(1.0, quota[k] / n) for k, n in sizes.items()}
    rate = lambda k: F.lit(rates.get(k, 0.0))
    rate = F.when(F.col("toxic") == 1, rate(1)).otherwise(rate(0))
    own = own.withColumn("rate", rate).withColumn("draw", F.xxhash64(F.lit(SEED), "doc_id"))
    own = own.filter((F.col("draw").cast("double") / 2.0**64 + 0.5) < F.col("rate"))  # about ``rows`` rows
    both = docs.select("doc_id", "text", "lang").filter(F.length("text") <= chars).join(F.broadcast(own), "doc_id")
    return both.select("text", "lang", "toxic", F.try_divide(F.lit(1.0), "rate").alias("weight"), "draw")


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text, lang, toxic, draw) of every labelled row; every fifth ``draw`` calibrates, the others train."""
    both = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "lang").join(checked(_labels(labels)), "doc_id")
    return both.withColumn("draw", F.xxhash64(F.lit(SEED), "doc_id"))


def fit(docs: DataFrame, labels: DataFrame, rows: int = ROWS, shard: int = SHARD) -> bytes:
    """The pickled model: network, languages' prototypes, thresholds by language and of all. Empty without both labels."""
    every = stored(labelled(docs, labels), "toxicity-labelled")
    sizes = _sizes(every)
    if len(sizes) < 2:
        return b""
    first = _first(every, labels, rows)
    many = sum(sizes.values())
    net = _mean(first, every, {k: many / 2 / n for k, n in sizes.items()}, math.ceil(many / shard), max(1, min(PASSES, AGAIN // many)))
    tongues = langid.fit(every)
    own, of_all = _thresholds(every, net, tongues)
    return pickle.dumps((net, tongues, own, of_all))


def _first(every: DataFrame, labels: DataFrame, rows: int) -> bytes:
    """The pickled learner with which all shards begin."""

    def learn(batches):
        found = [b.to_pandas() for b in batches]
        rows = pd.concat(found) if found else pd.DataFrame({"toxic": [], "text": [], "draw": []})
        rows = rows[rows["draw"] % 5 != 0].sort_values(["draw", "text"], kind="stable")
        texts = [[w for part in words(t) for w in part] for t in rows["text"]]
        fits = np.cumsum([len(t) for t in texts]) <= WORDS
        texts, toxic = [t for t, ok in zip(texts, fits, strict=True) if ok], rows["toxic"].to_numpy(np.float32)[fits]
        learner = train(texts, toxic) if texts else Learner()
        yield pa.RecordBatch.from_pydict({"model": pa.array([pickle.dumps(learner)], pa.binary())})
        give_back()

    found = sample(every, labels, rows).select("text", "toxic", "draw").repartition(1).mapInArrow(learn, "model binary").collect()
    return bytes(found[0]["model"]) if found else pickle.dumps(Learner())


def _mean(first: bytes, every: DataFrame, weights: dict[int, float], shards: int, passes: int) -> Network:
    """The network after ``passes`` over all training rows: the first one and the mean of the shards' changes to it."""

    def learn(batches):
        learner, begun = pickle.loads(first), pickle.loads(first)
        rng = np.random.default_rng(SEED + TaskContext.get().partitionId())
        held, size, any_row = [], 0, False

        def settle():
            toxic = np.array([t for _, t in held], np.float32)
            learner.learn([w for w, _ in held], toxic, np.array([weights[int(t)] for t in toxic], np.float32), [STEP * GOES_ON] * passes, rng)

        for batch in batches:
            for part in pieces(batch, "text", 4 << 20):
                for text, toxic in zip(part.column("text").to_pylist(), part.column("toxic").to_pylist(), strict=True):
                    held.append(([w for p in words(text) for w in p], toxic))
                    size, any_row = size + len(held[-1][0]), True
                    if size > CHUNK:
                        settle()
                        held, size = [], 0
        if held:
            settle()
        if any_row:
            change = learner.net.table - begun.net.table
            met = change.any(1)
            slabs = np.flatnonzero(met.reshape(-1, SLAB).any(1))
            wide = [change[s * SLAB : (s + 1) * SLAB].tobytes() for s in slabs]
            dense = np.concatenate([(a - b).ravel() for a, b in zip(learner.dense(), begun.dense(), strict=True)] + [[learner.net.constant - begun.net.constant]])
            number = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_pydict({"slab": pa.array([*slabs, -1], pa.int32()), "shard": pa.array([number] * (len(slabs) + 1), pa.int32()), "change": pa.array([*wide, dense.astype(np.float32).tobytes()], pa.binary())})
        give_back()

    def add(table: pa.Table) -> pa.Table:
        table = table.sort_by("shard")
        slab, total, n = table["slab"][0].as_py(), 0.0, 0
        for value in table["change"]:
            change = np.frombuffer(value.as_buffer(), np.float32).astype(np.float64)
            change = change.reshape(SLAB, SIZE) if slab >= 0 else change.reshape(1, -1)
            total, n = total + change, n + change.any(1, keepdims=True)
        mean = (total / np.maximum(n, 1)).astype(np.float32)
        return pa.table({"slab": pa.array([slab], pa.int32()), "change": pa.array([mean.tobytes()], pa.binary())})

    rows = every.filter("draw % 5 != 0").select("text", "toxic", "draw").repartition(shards, "draw").sortWithinPartitions("draw", "text")
    changes = rows.mapInArrow(learn, "slab int, shard int, change binary").groupBy("slab").applyInArrow(add, "slab int, change binary")
    learner = pickle.loads(first)
    for row in changes.collect():  # the size of one network, whatever the number of rows
        change = np.frombuffer(row["change"], np.float32)
        if row["slab"] >= 0:
            learner.net.table[row["slab"] * SLAB : (row["slab"] + 1) * SLAB] += change.reshape(SLAB, SIZE)
            continue
        at = 0
        for value in learner.dense():
            value += change[at : at + value.size].reshape(value.shape)
            at += value.size
        learner.net.constant += change[at]
    return learner.net


def _thresholds(every: DataFrame, net: Network, tongues: tuple) -> tuple[dict[str, float], float]:
    """Thresholds by language and of all, from all calibration rows: their numbers by language, step of the logit and label."""
    model = pickle.dumps((net, tongues, {}, 0.0))
    key = hashlib.sha256(model).digest()

    def run(batch: pa.RecordBatch) -> dict:
        net, told, _, _ = _loaded(key, model)
        texts = batch.column("text").to_pylist()
        logits = score_words(net, [words(t) for t in texts])
        return {"named": pa.array([told.language(t) for t in texts], pa.string()), "at": pa.array(np.round(np.clip(logits, -100, 100) * STEPS).astype(np.int32)), "toxic": batch.column("toxic")}

    told = map_texts(every.filter("draw % 5 = 0").select("text", "toxic"), run, "named string, at int, toxic int", "text")
    found = told.groupBy("named", "at", "toxic").agg(F.count("*").alias("n")).toPandas()  # 200 * STEPS rows a language and label at most
    edge = lambda some: threshold(some["at"].to_numpy() / STEPS, some["toxic"].to_numpy(np.float64), some["n"].to_numpy(np.float64))
    found = found.sort_values(["named", "at", "toxic"])
    per = {name: some for name, some in found.groupby("named") if some["n"][some["toxic"] == 1].sum() >= FEW}
    return {name: edge(some) for name, some in per.items()}, edge(found) if found["toxic"].any() else 0.0


_MODELS: dict[bytes, tuple] = {}


def _loaded(key: bytes, model: bytes) -> tuple:
    if key not in _MODELS:
        _MODELS.clear()
        net, tongues, own, every = pickle.loads(model) if model else (None, None, {}, 0.0)
        _MODELS[key] = net, langid.Teller(*tongues) if net else None, own, every
    return _MODELS[key]


def predict(df: DataFrame, model: bytes, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, ``score`` from 0 to 1 and ``predicted``: 1 from ``CUT`` on."""
    key = hashlib.sha256(model).digest()
    keep = tuple(k for k in keep if k not in ("score", "predicted"))

    def run(batch: pa.RecordBatch) -> dict:
        net, told, own, every = _loaded(key, model)
        texts = [t or "" for t in batch.column("__text").to_pylist()]
        scores = np.zeros(len(texts))
        if net is not None:
            shift = np.array([own.get(told.language(t), every) if own else every for t in texts])
            apart = score_words(net, [words(t) for t in texts]).astype(np.float64) - shift
            scores = np.round(1 / (1 + np.exp(-np.clip(apart + np.log(CUT / (1 - CUT)), -30, 30))), 6)
        return {k: batch.column(k) for k in keep} | {"score": pa.array(scores), "predicted": pa.array((scores >= CUT).astype(np.int32), pa.int32())}

    own = df.select(*keep, df[text_col].cast("string").alias("__text"))
    return map_texts(own, run, ddl(own) + "score double, predicted int", "__text")


def op11(spark, sf_dir):
    """Scores of all documents, learnt from the labels of those that are not held out."""
    docs = read_table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    labels = read_table(spark, sf_dir, "labels").select(F.col("doc_id").cast("long").alias("doc_id"), "toxic")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    model = fit(docs, labels.filter(~held))
    return predict(docs.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "text"), model, keep=("doc_id", "held_out"))
