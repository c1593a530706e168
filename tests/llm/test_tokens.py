"""Encoders against the tokenizers library, packing and rollups."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from cohortline.llm import bpe, byte_tokens, packing, token_rollup
from tests.llm.frames import TEXTS, documents

WORDS, BYTES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
PARTS = [*"ab'sS te'LL\n\t\x1c\x85  .é日0１　ΣAİǅẞ̸", "<|endoftext|>", "<|startoftext|>", "word", " word", "\r\n", "  ", "antidisestablishment" * 9]


def some_texts(n=1500):
    pick = random.Random(5)
    return ["".join(pick.choice(PARTS) for _ in range(pick.randint(0, 20))) for _ in range(n)]


@pytest.mark.parametrize(("path", "module"), [(WORDS, bpe), (BYTES, byte_tokens)])
def test_ids_equal_the_library(path, module):
    texts = some_texts() + [t for _, t in TEXTS if t]
    library = Tokenizer.from_file(path)
    want = [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(x, "<i4").tolist() for x in module.coder(path).encode(texts)] == want
    assert module.coder(path).encode([None, ""]) == [b"", b""]


def test_encode_and_decode_table(spark):
    docs = documents(spark)
    rows = bpe.decode(bpe.encode(docs, WORDS), WORDS).collect()
    library = Tokenizer.from_file(WORDS)
    assert len(rows) == len(TEXTS)
    want = sorted((str(i), library.encode(t or "", add_special_tokens=False).ids) for i, t in TEXTS)
    assert sorted((str(r["doc_id"]), r["ids"]) for r in rows) == want
    assert all(r["decoded"] == library.decode(r["ids"], skip_special_tokens=False) for r in rows)
    assert bpe.decode(bpe.encode(documents(spark, []), WORDS), WORDS).count() == 0


def test_pieces_tile_documents_and_sequences(spark):
    rows = packing.pack(documents(spark), BYTES).collect()
    library = Tokenizer.from_file(BYTES)
    want = sorted(tuple([*library.encode(t or "", add_special_tokens=False).ids, 0]) for i, t in TEXTS if i is not None and i != 6)
    got = {}
    for r in sorted(rows, key=lambda r: (str(r["doc_id"]), r["start"])):
        if r["doc_id"] not in (None, 6):
            got.setdefault(r["doc_id"], []).extend(np.frombuffer(r["ids"], "<i4").tolist())
    assert sorted(map(tuple, got.values())) == want
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
    assert sum(r["doc_id"] == 6 for r in rows) % 2 == 0
    assert packing.pack(documents(spark, []), BYTES).count() == 0


def test_many_shares_give_whole_sequences(spark):
    lengths = [(i, 0, 1 + (i * 37) % 1024) for i in range(4000)]
    rows = packing.place(spark.createDataFrame(lengths, "doc_id long, start long, length long"), share=150, fold=4).collect()
    assert sorted((r["doc_id"], r["length"]) for r in rows) == sorted((i, n) for i, _, n in lengths)
    used = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == used.get(r["sequence_id"], 0)
        used[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(used.values()) <= 1024
    # every class but its last leftovers is full, so at most one sequence of each class is short of k pieces
    assert len(used) <= sum(n for _, _, n in lengths) / 1024 * 1.6 + 40


def test_cuts_are_lossless_and_near_classes():
    for rest, lengths in enumerate(packing.cuts(1024)):
        assert sum(lengths) == rest
        assert sum(1024 // (1024 // n) - n for n in lengths) <= max(16, 0.1 * rest)


def test_rollup_is_additive_and_idempotent(spark, tmp_path):
    kind = "source string, lang string, n long, m long"
    one = spark.createDataFrame([("a", "en", 5, 7), ("a", "en", 3, 3), (None, "de", 2, None), ("b", None, 4, 1)], kind)
    store = token_rollup.Rollup(spark, str(tmp_path / "r"))
    assert store.totals().count() == 0
    assert store.commit("load", token_rollup.inserted(one, "v1", "n"))
    assert not store.commit("load", token_rollup.inserted(one, "v1", "n"))
    assert store.commit("empty", token_rollup.inserted(one.limit(0), "v1", "n"))
    totals = lambda: {(r["source"], r["lang"], r["tokenizer"]): (r["n_docs"], r["n_tokens"]) for r in store.totals().collect()}
    assert totals() == {("a", "en", "v1"): (2, 8), (None, "de", "v1"): (1, 2), ("b", None, "v1"): (1, 4)}
    store.commit("revise", token_rollup.revised(one.where("source = 'a'"), "v1", "n", "m"))
    store.commit("delete", token_rollup.deleted(one.where("source is null"), "v1", "n"))
    assert totals() == {("a", "en", "v1"): (2, 10), ("b", None, "v1"): (1, 4)}
    (tmp_path / "r" / "batch=torn").mkdir()  # a driver died before the success mark
    assert totals() == {("a", "en", "v1"): (2, 10), ("b", None, "v1"): (1, 4)}
    assert store.commit("torn", token_rollup.deleted(one.where("source = 'b'"), "v1", "n"))
    assert totals() == {("a", "en", "v1"): (2, 10)}
    with pytest.raises(ValueError, match="batch names"):
        store.commit("../x", token_rollup.inserted(one, "v1", "n"))


def test_counts_of_awkward_texts(spark):
    library = Tokenizer.from_file(BYTES)
    rows = token_rollup.bpe_counts(documents(spark), BYTES, n_tokens="text").collect()
    assert sorted(r["n_tokens"] for r in rows) == sorted(len(library.encode(t or "", add_special_tokens=False).ids) for _, t in TEXTS)
    assert zlib.crc32(b"") == 0


def test_word_cache_is_bounded_in_bytes():
    from cohortline.llm.common import WordCache

    cache, made = WordCache(limit=100_000), []
    make = lambda words: made.extend(words) or [w.encode() for w in words]
    words = [f"w{i}" for i in range(5000)] + ["long" * 250_000, ("first",)]
    take = lambda some: cache.values(some, lambda new: make([w[0] if isinstance(w, tuple) else w for w in new]))
    assert take(words) == [(w[0] if isinstance(w, tuple) else w).encode() for w in words]
    assert cache.size <= 100_000 + 1000 and len(cache.new) + len(cache.old) < 1000
    assert not any(len(w) > WordCache.LONGEST for w in [*cache.new, *cache.old])
    take(words[-1:])
    made.clear()
    assert take(words[-1:] * 3) == [b"first"] * 3 and made == []
    cache.clear()
    assert cache.values(["a", "a"], lambda new: [b"A" for _ in new]) == [b"A", b"A"] and cache.size > 0


def test_placing_keeps_columns_of_any_name(spark):
    rows = [(i, 0, 300 + i, "mine", "yours", 7, 8, 9) for i in range(20)]
    pieces = spark.createDataFrame(rows, "doc_id long, start long, length long, _k string, _share string, _n int, _rank int, _bin int")
    got = packing.place(pieces).collect()
    assert sorted(tuple(r)[:8] for r in got) == rows


def test_byte_coder_on_long_runs():
    """Runs of white space of any length, letters without spaces, and marks of special tokens."""
    from cohortline.llm.byte_tokens import ByteBpe

    library, coder = Tokenizer.from_file(BYTES), ByteBpe(BYTES)
    texts = ["a" + " " * 1_000_000 + "b", "\n \t" * 5000, " " * 9999 + "x", "y" * 200_000, "#" * 50_000, "<|endoftext|>" + " " * 20_000 + "<|endoftext|> z", "it's <|endoftext|>\u3000 x", "", None]
    assert coder.encode(texts) == [np.array(library.encode(t or "", add_special_tokens=False).ids, "<i4").tobytes() for t in texts]
