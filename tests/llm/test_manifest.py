"""Merkle manifests against a slow version."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from cohortline.llm import merkle, queries

FIELDS = ["doc_id", "source", "text"]
KIND = "doc_id long, source string, text string, t string, node string, leaf string, witness int, pos int, key string"


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z", 1, 2, "k") for r in rows], KIND)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def levels_of(nodes):
    """All levels of one tree, the leaves first."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i:i + 16])) for i in range(0, len(levels[-1]), 16)])
    return levels


def siblings(levels, at):
    out = ""
    for nodes in levels[:-1]:
        start = at - at % 16
        out += "".join(n for i, n in enumerate(nodes[start:start + 16], start) if i != at)
        at //= 16
    return out


def slow(rows):
    """Sorted (doc_id, leaf, subroot, root, siblings) of all rows."""
    trees = {}
    for r in rows:
        trees.setdefault(r[1], []).append(r)
    names = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    built = {}
    for s in names:
        own = sorted(trees[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        built[s] = own, levels_of([leaf(r) for r in own])
    top = levels_of([built[s][1][-1][0] for s in names])
    out = []
    for place, s in enumerate(names):
        own, levels = built[s]
        for at, r in enumerate(own):
            out.append((r[0], leaf(r), levels[-1][0], top[-1][0], siblings(levels, at) + siblings(top, place)))
    return sorted(out, key=repr)


def many():
    rows = [(i, f"s{i % 20}" if i % 3 else "hot", f"Text {i}") for i in range(700)]
    rows += [(i, None, None) for i in range(17)] + [(5000, "é", "lone"), (None, "hot", "no id"), (None, "hot", "no id"), (7, "hot", "same id"), (9, "", "Ü" * 50_000)]
    return rows + rows[:5]


@pytest.mark.parametrize("levels", [1, 2, 3])
def test_equals_slow_version(spark, monkeypatch, levels):
    """With blocks of one, two and three levels, so that block roots are appended at several heights."""
    monkeypatch.setattr(merkle, "BLOCK_LEVELS", levels)
    rows = many()
    found = merkle.manifest(table(spark, rows), FIELDS)
    got = found.select("doc_id", "leaf", "subroot", "root", merkle.siblings(F.col("witness")).alias("s"), merkle.folded(F.col("leaf"), F.col("witness")).alias("again"))
    got = got.collect()
    assert sorted([tuple(r)[:5] for r in got], key=repr) == slow(rows)
    assert all(r["again"] == r["root"] for r in got)


def test_joined_offsets(spark, monkeypatch):
    monkeypatch.setattr(merkle, "BROADCAST_PARTS", -1)
    rows = many()
    assert {r["root"] for r in merkle.manifest(table(spark, rows), FIELDS).collect()} == {slow(rows)[0][3]}


def test_small_tables(spark):
    assert merkle.manifest(table(spark, []), FIELDS).count() == 0
    one = merkle.manifest(table(spark, [(1, None, None)]), FIELDS, keep=["t", "leaf"]).collect()
    assert [tuple(r) for r in one] == [(1, "x", leaf((1, None, None)), leaf((1, None, None)), leaf((1, None, None)), [])]


def test_block_extends_open_witnesses():
    """A leaf's witness grows only when a subtree above it is complete."""
    block = merkle.Block(2)
    for i in range(15):
        block.append(sha(str(i)))
    assert block.witness == [[]] * 15
    block.append(sha("15"))
    assert [len(w) for w in block.witness] == [1] * 16 and block.root is None
    block.append(sha("16"))
    root = block.finish()
    assert [len(w) for w in block.witness] == [2] * 17
    assert root == levels_of([sha(str(i)) for i in range(17)])[-1][0]


def test_query_finds_tampering(spark):
    folder = "/root/testdata/sf0.001"
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = queries.QUERIES["op11_merkle_manifest"](spark, folder).collect()
    assert len(rows) == len(docs)
    for r in rows:
        changed = zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 and any("A" <= c <= "Z" for c in docs[r["doc_id"]] or "")
        assert r["verified"] == (not changed) == (r["folded_root"] == r["root"])
