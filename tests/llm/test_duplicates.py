"""Near duplicates of documents and lines against brute force."""

import random
import re

import numpy as np
import pyarrow as pa
import xxhash

import corpus_pipeline
from cohortline.llm import components, line_dedup, simhash
from tests.llm.frames import TEXTS, documents


def plain_fingerprint(text):
    words = re.findall("[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    counts = [sum(xxhash.xxh64_intdigest(s.encode(), 42) >> b & 1 for s in shingles) for b in range(64)]
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))


def roots(nodes, edges):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_fingerprints(spark):
    rows = simhash.fingerprints(documents(spark)).collect()
    assert sorted((str(r["doc_id"]), r["fp"] % 2**64) for r in rows) == sorted((str(i), plain_fingerprint(t)) for i, t in TEXTS)


def clustered(n, seed):
    make = np.random.default_rng(seed)
    out = set()
    for base in make.integers(-2**63, 2**63 - 1, n // 40):
        for _ in range(40):
            v = int(base) % 2**64
            for bit in make.integers(0, 64, make.integers(0, 5)):
                v ^= 1 << int(bit)
            out.add(v - 2**64 if v >= 2**63 else v)
    return sorted(out)


def test_links_at_every_depth(spark):
    """Buckets that hold, that are parted again, and that end in tiles give the same components."""
    values = clustered(800, 1)
    near = [(a, b) for i, a in enumerate(values) for b in values[:i] if ((a ^ b) % 2**64).bit_count() <= 3]
    want = roots(values, near)
    table = spark.createDataFrame([(v,) for v in values], "fp long")
    for bucket, depth in ((1024, 4), (8, 4), (4, 1)):
        edges = [(r["u"], r["v"]) for r in simhash.links(table, bucket, depth).collect()]
        assert all(((a ^ b) % 2**64).bit_count() <= 3 for a, b in edges)
        assert roots(values, edges) == want


def test_radius_below_three():
    values = np.array(clustered(200, 2), np.int64)
    for radius in (0, 1, 2, 3):
        u, v = simhash.linked(values, np.zeros(len(values), np.int64), radius=radius)
        near = [(int(a), int(b)) for i, a in enumerate(values) for b in values[:i] if ((int(a) ^ int(b)) % 2**64).bit_count() <= radius]
        assert roots(values.tolist(), zip(u.tolist(), v.tolist(), strict=True)) == roots(values.tolist(), near)


def test_groups_and_one_of_each(spark):
    docs = documents(spark)
    found = {r["doc_id"]: r["component"] for r in simhash.near_duplicates(docs).collect() if r["doc_id"] is not None}
    assert found[2] == 1 and found[4] == found[7] == 3 and found[6] == 6 and found[8] == 8
    kept = [r["doc_id"] for r in simhash.one_of_each(docs).collect()]
    assert sorted(map(str, kept)) == ["1", "3", "5", "6", "6", "8", "None"]
    assert simhash.one_of_each(docs).columns == docs.columns
    assert simhash.near_duplicates(documents(spark, [])).count() == 0


def test_one_row_of_each_group(spark):
    """The stage keeps one row of a repeated key, and a key's row in one group does not decide on its row in another."""
    other = "quite another text that has nothing to do with the first one at all"
    rows = [(1, other), (2, TEXTS[0][1]), (2, TEXTS[0][1]), (2, TEXTS[0][1].upper()), (2, other), (3, TEXTS[0][1]), (4, "alone"), (None, other), (None, other)]
    docs = documents(spark, rows).selectExpr("doc_id", "text", "'en' AS lang", "'web' AS source", "1L AS n_chars")
    kept = corpus_pipeline.one_of_each_group(spark, docs, "").collect()
    assert sorted((str(r["doc_id"]), r["text"].lower()) for r in kept) == sorted([("1", other), ("2", TEXTS[0][1]), ("4", "alone"), ("None", other), ("None", other)])


def test_components(spark):
    chain = [(i, i + 1) for i in range(60)] + [(200, 100), (100, 200), (7, 7), (300, 301), (301, 302), (300, 302), (None, 3)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(chain, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 200: 100, 300: 300, 301: 300, 302: 300}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def edited(pick, text, times):
    out = list(text)
    for _ in range(times):
        at = pick.randint(0, len(out))
        kind = pick.randint(0, 2)
        if kind == 0 or at == len(out):
            out.insert(at, pick.choice("abé"))
        elif kind == 1:
            del out[at]
        else:
            out[at] = pick.choice("abé")
    return "".join(out)


def test_banded_distance_and_segments():
    pick = random.Random(7)
    first = ["".join(pick.choice("abé") for _ in range(pick.randint(0, 45))) for _ in range(1200)]
    second = [edited(pick, x, pick.randint(0, 4)) if x else "ab" for x in first]
    for limit in (1, 2, 3):
        assert line_dedup.within(first, second, limit).tolist() == [edits(a, b) <= limit for a, b in zip(first, second, strict=True)]
    odd = line_dedup.parities(first) ^ line_dedup.parities(second)
    assert all(int(x).bit_count() <= 2 * edits(a, b) for x, a, b in zip(odd.view(np.uint64), first, second, strict=True))
    for a, b in zip(first, second, strict=True):
        short, long = sorted((a, b), key=len)
        if len(short) >= 6 and edits(a, b) <= 2:
            index = {(len(short), i, short[s:s + n]) for i, (s, n) in enumerate(line_dedup.segments(len(short)))}
            assert any((n, i, long[s:s + m]) in index for n, i, s, m in line_dedup.probes(len(long), 2, 6))


def line_table(pick):
    base = ["".join(pick.choice("abcdé ") for _ in range(pick.randint(26, 50))) + "z" for _ in range(40)]
    rows = []
    for i in range(90):
        some = [edited(pick, pick.choice(base), pick.randint(0, 3)) for _ in range(4)] + ["", "short", " \t"]
        rows.append((i, "\n".join(some)))
    return rows


def test_line_classes_with_and_without_tiles(spark):
    rows = line_table(random.Random(11))
    held = {}
    for i, text in rows:
        for k, x in enumerate(text.split("\n")):
            if x.strip():
                held.setdefault(x, []).append((i, k))
    long = [x for x in held if len(x) >= 24]
    near = [(a, b) for i, a in enumerate(long) for b in long[:i] if abs(len(a) - len(b)) <= 2 and edits(a, b) <= 2]
    want, degree = roots(held, near), {}
    for a, b in near:
        degree[a], degree[b] = degree.get(a, 0) + 1, degree.get(b, 0) + 1
    first = {}
    for x, places in held.items():
        first[want[x]] = min([first.get(want[x], (1e9, 0)), *places])
    expected = sorted((i, k, *first[want[x]], degree.get(x, 0), (i, k) == first[want[x]]) for x, places in held.items() for i, k in places)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(r) for r in line_dedup.classes(docs).collect()]
    assert sorted(got) == expected
    assert near
    pairs = {frozenset([(r["a"], r["b"]), (r["c"], r["d"])]) for r in line_dedup.links(docs, together=2).collect()}
    assert len(pairs) == len(near)


def test_large_keys_are_not_held():
    """A task keeps no more of a key than it can compare, and hands the key on if it has both sides."""
    held = []

    def batches(probe, n=200, rows=1000):
        for i in range(n):
            a = np.arange(i * rows, (i + 1) * rows)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(rows, 5)), pa.array(a), pa.array(a), pa.array(a), pa.array(probe(a))], names=["key", "a", "b", "parity", "probe"])
            held.append(pa.total_allocated_bytes())

    before = pa.total_allocated_bytes()
    out = pa.Table.from_batches(line_dedup._pairs(batches(lambda a: a >= 100_000), 64, 2))
    assert out.column("hot").to_pylist() == [5]
    assert max(held) - before < 200_000
    assert not pa.Table.from_batches(line_dedup._pairs(batches(lambda a: a >= 0), 64, 2)).num_rows


def test_large_keys_are_known_before_rows_are_dealt(spark):
    """Numbered lines of one form: their keys come from the sample, are parted by parities, and lose no link."""
    pick = random.Random(3)
    held = sorted({f"licensed under the terms {pick.randint(0, 9999):04d} of page" for _ in range(300)})
    near = [(a, b) for i, a in enumerate(held) for b in held[:i] if edits(a, b) <= 2]
    docs = spark.createDataFrame([(i, x) for i, x in enumerate(held)], "doc_id long, text string")
    assert line_dedup._large(docs, "text", 2, 24, 16, sample=4).count() > 0
    keys = line_dedup._keys(docs, "text", 2, 24)
    assert keys.groupBy("key").count().agg({"count": "max"}).first()[0] == 2 * len(held)
    parted = line_dedup._parted(keys.distinct(), 2).groupBy("key").count().agg({"count": "max"}).first()[0]
    assert parted < 2 * len(held)
    pairs = {frozenset([(r["a"], r["b"]), (r["c"], r["d"])]) for r in line_dedup.links(docs, together=16).collect()}
    assert len(pairs) == len(near)


def test_lines_removed(spark):
    docs = documents(spark)
    got = sorted(((str(r["doc_id"]), r["text"]) for r in line_dedup.without_duplicates(docs).collect()), key=str)
    texts = dict(got)
    assert texts["1"] == TEXTS[0][1] and texts["2"] == "" and texts["3"] == "" and texts["4"] is None and texts["5"] == TEXTS[4][1]
    assert texts["None"] == "no id at all" and texts["7"] == TEXTS[8][1]
    assert line_dedup.without_duplicates(docs).columns == docs.columns
    shuffled = line_dedup.without_duplicates(docs, broadcast_lines=-1).collect()
    assert sorted(((str(r["doc_id"]), r["text"]) for r in shuffled), key=str) == got
    assert line_dedup.classes(documents(spark, [])).count() == 0
