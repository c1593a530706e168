"""Registered corpus queries on the smallest tables, and the pipeline stage by stage."""

import re

import pytest

import __spark_entry__ as entry_point
import corpus_pipeline
from cohortline.llm import line_dedup, simhash, surrogates
from cohortline.llm import queries as corpus_queries
from tests.oracle_check import compare, connect

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(corpus_queries.ORACLES))
def test_oracle(spark, name):
    assert compare(spark, FOLDER, corpus_queries.QUERIES[name], corpus_queries.ORACLES[name], connect(FOLDER)) == []


def test_every_operator_has_its_query():
    names = entry_point.queries()
    assert all(sum(n.startswith(f"op{i}_") for n in names) == 1 for i in range(1, 14)) and "pipeline" in names


def test_rollup_query(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    seen, want = set(), {}
    for i, source, lang, text in sorted(connect(FOLDER).sql("select doc_id, source, lang, text from documents").fetchall()):
        if text not in seen:
            seen.add(text)
            text = re.sub(corpus_queries.LICENCE_LINE, "", text)
            for version, n in (("byte_bpe_50k", len(library.encode(text, add_special_tokens=False).ids)), ("words-1", len(re.findall("[^\x20\x09-\x0D]+", text)))):
                d, t = want.get((source, lang, version), (0, 0))
                want[source, lang, version] = (d + 1, t + n)
    rows = corpus_queries.QUERIES["op1_token_rollup"](spark, FOLDER).collect()
    assert {(r["source"], r["lang"], r["tokenizer"]): (r["n_docs"], r["n_tokens"]) for r in rows} == want


def test_pipeline_on_awkward_tables(spark, tmp_path):
    """All stages in a row over null ids, repeated rows, empty and long texts, and over no rows at all."""
    from tests.llm.frames import TEXTS

    rows = [(i, t, "en", "a", len(t or "")) for i, t in TEXTS] + [(None, None, None, None, None)]
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    for name, some in (("full", rows), ("empty", [])):
        folder = tmp_path / name
        spark.createDataFrame(some, kind).write.parquet(str(folder / "documents.parquet"))
        spark.createDataFrame([(i, 1, 0) for i in range(9)] if some else [], "doc_id long, quality int, toxic int").write.parquet(str(folder / "labels.parquet"))
        pieces = corpus_pipeline.run(spark, str(folder)).collect()
        assert {r["doc_id"] for r in pieces} <= {i for i, *_ in some}
        assert (len(pieces) > 0) == bool(some)
        used = {}
        for r in sorted(pieces, key=lambda r: (r["sequence_id"], r["offset"])):
            assert r["offset"] == used.get(r["sequence_id"], 0)
            used[r["sequence_id"]] = r["offset"] + r["length"]
        assert max(used.values(), default=0) <= 1024


def test_rollup_of_copies_and_nulls(spark, tmp_path):
    """Equal rows, equal texts under other ids, and null texts count once; licence lines do not count."""
    licence = "some words here\nLicensed under terms"
    rows = [(1, licence, "en", "a"), (1, licence, "en", "a"), (7, licence, "en", "b"), (2, None, "en", "a"), (3, None, "de", "b"), (None, None, "de", "c"), (4, "", "en", "a"),
            (5, "two words", "en", "a"), (5, "two words", "en", "a"), (6, "Licensed under x", None, None)]
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_queries.QUERIES["op1_token_rollup"](spark, str(tmp_path)).where("tokenizer = 'words-1'").collect()
    assert {(r["source"], r["lang"]): (r["n_docs"], r["n_tokens"]) for r in got} == {("a", "en"): (3, 5), ("c", "de"): (1, 0), (None, None): (1, 0)}


def test_pipeline_stages(spark, tmp_path):
    docs, kept = spark.read.parquet(f"{FOLDER}/documents.parquet"), {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, FOLDER).write.parquet(str(tmp_path / str(i)))
        before, docs = docs, spark.read.parquet(str(tmp_path / str(i)))
        kept[name] = {r["doc_id"]: r for r in docs.collect()}
        if name != "packing":
            assert docs.columns == corpus_pipeline.COLUMNS
        if name == "line_dedup":
            lines = [x for r in kept[name].values() for x in r["text"].split("\n") if x.strip()]
            assert len(lines) == len(set(lines))
            assert set(kept[name]) == {r["doc_id"] for r in before.collect()}
            assert line_dedup.links(docs).count() == 0
        if name == "near_duplicates":
            groups = simhash.near_duplicates(before).collect()
            assert set(kept[name]) == {r["component"] for r in groups}
        if name == "personal_data":
            real = {m.norm for r in before.collect() for m in surrogates.mentions(r["text"])}
            assert real and real.isdisjoint(m.norm for r in docs.collect() for m in surrogates.mentions(r["text"]))
        if name == "packing":
            assert {r["doc_id"] for r in docs.collect()} == {r["doc_id"] for r in before.collect()}
    labels = connect(FOLDER).sql("select doc_id, toxic from labels").fetchall()
    clean = [i for i, toxic in labels if not toxic]
    assert sum(i in kept["toxicity"] for i in clean) >= 0.95 * len(clean)
    assert sum(i in kept["toxicity"] for i, toxic in labels if toxic) < 0.5 * (len(labels) - len(clean))
