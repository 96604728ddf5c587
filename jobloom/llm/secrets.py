"""Secret scan with multipart credential linking.

A scan finds base secrets (assignments, access identifiers, hex strings) and weak parts that mean nothing
alone: long mixed tokens that could be a secret, and endpoints. A weak part is reported only when the
interval join finds a complementary part within the same scope: an access identifier, a weak secret and,
where there is one, an endpoint whose intervals, widened by ``reach``, meet in one document.

Defined results: null text is the empty text and has no spans; offsets count code points, end exclusive;
rows are told apart by an id of their own, so repeated rows and null ids keep their own spans.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ddl, map_texts, read_table, row_key, stored, type_name

# The base patterns and the least lengths that the contract of the scan states.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
#: A quick look at lower-cased texts before the full pattern.
WORDS = re.compile(r"""(?:passw|secret|token|api_?key)[a-z]*["']?\x20*[:=]""")
KINDS = ("assign", "access", "hex", "endpoint", "weak")
LEAST_ASSIGN, LEAST_ACCESS = 8, 16

#: Weak parts: an address with a host, and a token of 40 or more base64 characters of three classes.
ENDPOINT = re.compile(r"https?://[A-Za-z0-9.-]+(?::[0-9]+)?[^\s\"'<>]*", re.A)
WEAK = re.compile(r"(?<![A-Za-z0-9+/=_-])[A-Za-z0-9+/_-]{40,}={0,2}(?![A-Za-z0-9+/=_-])", re.A)
#: Code points within which parts of one credential stand.
REACH = 400


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of every base secret, in the order of start, then kind."""
    found = []
    if ("=" in text or ":" in text) and WORDS.search(text.lower()):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_ASSIGN]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def weak_spans(text: str) -> list[tuple[int, int, int]]:
    """Endpoints and tokens of mixed classes; only texts that hold an access identifier or assignment are asked."""
    found = [(m.start(), 3, m.end()) for m in ENDPOINT.finditer(text)] if "://" in text else []
    for m in WEAK.finditer(text):
        word = m.group()
        if sum(bool(re.search(c, word)) for c in ("[A-Z]", "[a-z]", "[0-9]")) == 3:
            found.append((m.start(), 4, m.end()))
    return sorted(found)


def parts(df: DataFrame, text_col: str, keep: tuple[str, ...]) -> DataFrame:
    """One row per input row: ``keep`` columns, ``base`` and ``weak`` arrays of (start, kind, end)."""

    def run(batch: pa.RecordBatch) -> dict:
        texts = [t or "" for t in batch.column("__text").to_pylist()]
        base = [base_spans(t) for t in texts]
        weak = [weak_spans(t) if any(k < 2 for _, k, _ in b) else [] for t, b in zip(texts, base, strict=True)]
        kind = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int64()), ("end", pa.int64())]))
        named = lambda rows: pa.array([[{"start": s, "kind": k, "end": e} for s, k, e in r] for r in rows], kind)
        return {k: batch.column(k) for k in keep} | {"base": named(base), "weak": named(weak)}

    own = df.select(*keep, df[text_col].cast("string").alias("__text"))
    span = "array<struct<start: long, kind: long, end: long>>"
    return map_texts(own, run, f"{ddl(own)}base {span}, weak {span}", "__text")


def linked(found: DataFrame, key: str, reach: int = REACH) -> DataFrame:
    """(key, spans): the weak parts of each row that complementary parts stand near.

    The interval join is an equi-join on (row, cell of ``2 * reach`` code points): a part enters each cell
    that its widened interval touches, so parts whose widened intervals meet share a cell. A weak token
    needs an access identifier or an assignment near it; an endpoint needs a token that was itself linked.
    """
    cell = 2 * reach
    cells = lambda c: F.explode(F.sequence(F.expr(f"({c}.start - {reach}) div {cell}"), F.expr(f"({c}.end + {reach}) div {cell}")))
    some = found.filter(F.size("weak") > 0).dropDuplicates([key])
    weak = some.select(key, F.explode("weak").alias("w")).select(key, "w", cells("w").alias("cell"))
    strong = some.select(key, F.explode("base").alias("s")).filter("s.kind < 2").select(key, "s", cells("s").alias("cell"))
    near = f"w.start - s.end <= {reach} AND s.start - w.end <= {reach}"
    tokens = weak.filter("w.kind = 4").join(strong, [key, "cell"]).filter(near).select(key, "w").distinct()
    as_strong = tokens.select(key, F.col("w").alias("s")).select(key, "s", cells("s").alias("cell"))
    ends = weak.filter("w.kind = 3").join(as_strong, [key, "cell"]).filter(near).select(key, "w").distinct()
    return tokens.union(ends).groupBy(key).agg(F.collect_list("w").alias("linked"))


def scan(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", reach: int = REACH) -> DataFrame:
    """One row per input row: ``doc_id``, ``base`` and ``linked`` arrays of (start, kind, end).

    A row is known by hashes of its id and text: rows that agree in both have the same spans, so they
    enter the join once and each of them gets its result.
    """
    own = df.select(df[id_col].alias("doc_id"), row_key(df[id_col], df[text_col]).alias("key"), df[text_col].alias("__text"))
    found = stored(parts(own, "__text", ("doc_id", "key")), "secrets")
    return found.join(linked(found, "key", reach), "key", "left").select("doc_id", "key", "base", F.coalesce("linked", F.filter("base", lambda _: F.lit(False))).alias("linked"))


def listing(spans) -> F.Column:
    """kind:start:end of each span, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    one = lambda s: F.concat_ws(":", F.element_at(names, (s["kind"] + 1).cast("int")), s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(spans, one), ",")


def masked(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", reach: int = REACH, mask: str = "[secret]") -> DataFrame:
    """``df`` with every reported span of its text replaced; all rows stay. Overlapping spans become one mask."""
    rest = F.struct(*([df[c] for c in df.columns if c != text_col] or [F.lit(0).alias("none")]))
    keyed = df.select(row_key(df[id_col], df[text_col]).alias("key"), df[text_col].cast("string").alias("text"), rest.alias("row"))
    found = scan(df, text_col, id_col, reach).select("key", F.array_sort(F.concat("base", "linked")).alias("spans"))
    some = found.filter(F.size("spans") > 0).dropDuplicates(["key"])
    both = keyed.join(some, "key", "left").select("row", "text", F.col("spans.start").alias("starts"), F.col("spans.end").alias("ends"))

    def run(batch: pa.RecordBatch) -> dict:
        texts = batch.column("text").to_pylist()
        spans = zip(texts, batch.column("starts").to_pylist(), batch.column("ends").to_pylist(), strict=True)
        return {"row": batch.column("row"), "text": pa.array([t if not s else _masked(t, s, e, mask) for t, s, e in spans], pa.string())}

    out = map_texts(both, run, f"row {type_name(both.schema['row'].dataType)}, text string", "text")
    return out.select(*[F.col("text").alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in df.columns])


def _masked(text: str, starts: list[int], ends: list[int], mask: str) -> str:
    out, at = [], 0
    for start, end in zip(starts, ends, strict=True):
        if start >= at:
            out += [text[at:start], mask]
        at = max(at, end)
    return "".join([*out, text[at:]])


def op7(spark, sf_dir):
    """doc_id, counts of base kinds, base_sha256 and all spans of every document."""
    found = scan(read_table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(listing(F.col("base")), 256).alias("base_sha256"),
        listing(F.array_sort(F.concat("base", "linked"))).alias("spans"),
    )
