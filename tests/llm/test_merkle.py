"""The Merkle manifest against plain Python: null fields, repeated and clashing rows, lone nodes, other arities."""

import hashlib
import zlib
from collections import Counter, defaultdict

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from jobloom.llm import entry, merkle

ROWS = [
    *[(i, f"text {i} é", ("en", "fr", "de")[i % 3] if i < 60 else "en", f"s{i % 4}", i) for i in range(95)],
    (200, None, None, None, None), (201, "", None, "", 0), (202, "x" * 100_000, "zz", None, 5), (7, "again", "en", "s", 3), (7, "again", "en", "s", 3),
    (None, "no id", "en", "s", 1), (None, "no id either", "en", "s", 1), (203, "ü", "ü", "s", None), (203, "-", "", "-", 2),
]


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(row, more=0):
    i, text, lang, source, n = row
    values = [i, source, lang, None if n is None else n + more, text]
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def tree(digests, arity):
    """Root, and for each leaf its steps (before, after)."""
    at, steps = list(range(len(digests))), [[] for _ in digests]
    while len(digests) > 1:
        runs = [digests[i : i + arity] for i in range(0, len(digests), arity)]
        for k, place in enumerate(at):
            run, slot = runs[place // arity], place % arity
            steps[k].append(("".join(run[:slot]), "".join(run[slot + 1 :])))
        digests, at = [h(*run) for run in runs], [p // arity for p in at]
    return digests[0], steps


def expected(rows, arity=2):
    groups = defaultdict(list)
    for row in rows:
        groups[row[2]].append(row)
    names = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    subs, out = [], []
    for name in names:
        mine = sorted(groups[name], key=lambda r: (r[0] is not None, r[0] or 0, plain_leaf(r)))
        subs.append((mine, *tree([plain_leaf(r) for r in mine], arity)))
    root, upper = tree([s[1] for s in subs], arity)
    for (mine, sub, steps), above in zip(subs, upper, strict=True):
        for row, own in zip(mine, steps, strict=True):
            path, odd = own + above, zlib.crc32(str(row[0]).encode()) % 7 == 0 and row[0] is not None
            end = plain_leaf(row, 1 if odd else 0)
            for before, after in path:
                end = h(before, end, after)
            out.append((row[0], plain_leaf(row), sub, root, h(*[b + a for b, a in path]), end, end == root))
    return Counter(out)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    at = tmp_path_factory.mktemp("merkle")
    i, text, lang, source, n = zip(*ROWS, strict=True)
    columns = {"doc_id": pa.array(i, pa.int64()), "text": text, "lang": lang, "source": source, "n_chars": pa.array(n, pa.int64()), "leaf": [1] * len(i), "tree": ["t"] * len(i), "at": [0] * len(i)}
    pq.write_table(pa.table(columns), at / "documents.parquet")
    (at / "none").mkdir()
    pq.write_table(pa.table(columns).slice(0, 0), at / "none" / "documents.parquet")
    return str(at)


def test_op13_equals_plain_python(spark, folder):
    rows = entry.queries()["op13_merkle_manifest"](spark, folder).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()
    got, want = Counter(map(tuple, rows)), expected(ROWS)
    assert got == want
    checked = {r["doc_id"]: r["verified"] for r in rows}
    odd = [r for r in ROWS if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0]
    assert len(odd) > 8 and all(checked[r[0]] == (r[4] is None) for r in odd) and sum(not v for v in checked.values()) == sum(r[4] is not None for r in odd)
    assert entry.queries()["op13_merkle_manifest"](spark, f"{folder}/none").collect() == []


@pytest.mark.parametrize("arity", [3, 5])
def test_other_arities_prove_every_row(spark, folder, arity):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = merkle.manifest(docs, "doc_id", "lang", ["doc_id", "source", "lang", "n_chars", "text"], arity)
    got = rows.select("id", "leaf", "subroot", "root", merkle.proof_digest(F.col("steps")).alias("proof"), merkle.folded(F.col("leaf"), F.col("steps")).alias("end")).collect()
    want = Counter()
    for (i, leaf, sub, root, proof, *_), n in expected(ROWS, arity).items():
        want[i, leaf, sub, root, proof, root] += n
    assert Counter(map(tuple, got)) == want


def test_a_single_row_is_its_own_root(spark):
    one = spark.createDataFrame([(1, "a")], "doc_id long, text string").withColumn("lang", F.lit(None).cast("string"))
    (row,) = merkle.manifest(one, "doc_id", "lang", ["doc_id", "text"]).collect()
    assert row["leaf"] == row["subroot"] == row["root"] == h("1:1", "1:a") and row["steps"] == []
