"""One query for each corpus operator, over its whole tables, and the SQL statements for those SQL can express."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortline.functions.sizing import cut_lineage, drop_cut, shared_folder
from cohortline.llm import bpe, hard_negatives, line_dedup, merkle, metric_search, packing, perspectives, simhash, surrogates, token_rollup, toxicity, url_rules
from cohortline.llm import quality_ledger as quality
from cohortline.llm.common import read_table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function
    return put


def documents(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    return read_table(spark, folder, "documents").select(*(columns or ["doc_id", "text"]))


LICENCE_LINE = "(^|\\n)Licensed under [^\\n]*"


@query("op1_token_rollup")
def token_totals(spark: SparkSession, folder: str) -> DataFrame:
    """Totals after four loads, one of them delivered twice, the removal of exact copies, and counts revised without licence lines.

    Rows of equal text are copies, whether or not their ids differ, and null texts are copies of each other; the one with the
    smallest id stays, rows without an id before others.
    """
    docs = documents(spark, folder, "doc_id", "source", "lang", "text")
    licensed = F.col("text").rlike(LICENCE_LINE)
    both = docs.withColumn("plain", F.when(licensed, F.regexp_replace("text", LICENCE_LINE, "")))
    both = both.withColumns({"words": token_rollup.word_counts(), "new_words": token_rollup.word_counts("plain"), "digest": F.sha2("text", 256)})
    counted = token_rollup.bpe_counts(both, public_tokenizers.path("byte_bpe_50k.json"), bpe="text", new_bpe="plain")
    counts = cut_lineage(counted.withColumn("licensed", F.col("plain").isNotNull()).drop("text", "plain").withColumn("row", F.monotonically_increasing_id()))
    # One row of each text stays: all rows are taken away and the first ones put back, so that no row has to find its copies.
    own = ["source", "lang", "licensed", "bpe", "words", "new_bpe", "new_words"]
    first = counts.groupBy("digest").agg(F.min_by(F.struct(*own), F.struct("doc_id", "row")).alias("first"))
    first = cut_lineage(first.select("first.*"))
    rollup = token_rollup.Rollup(spark, f"{shared_folder(spark)}/rollup-{uuid.uuid4().hex}")
    versions = {"byte_bpe_50k": "bpe", "words-1": "words"}
    for part in [0, 1, 2, 3, 2]:
        some = counts.where(F.pmod(F.xxhash64("doc_id"), F.lit(4)) == part)
        rollup.commit(f"load-{part}", *[token_rollup.inserted(some, v, c) for v, c in versions.items()])
    rollup.commit("copies", *[change(rows, v, c) for change, rows in ((token_rollup.deleted, counts), (token_rollup.inserted, first)) for v, c in versions.items()])
    rollup.commit("licences", *[token_rollup.revised(first.where("licensed"), v, c, f"new_{c}") for v, c in versions.items()])
    drop_cut(counts, first)
    return rollup.totals()


@query("op2_simhash_groups")
def simhash_groups(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, folder))
    return found.select("doc_id", simhash.as_hex(F.col("fp")).alias("fingerprint"), F.col("component").alias("component_id"))


@query("op3_bpe_round_trip")
def bpe_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    both = bpe.decode(bpe.encode(documents(spark, folder), path).drop("text"), path)
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


@query("op4_harmonic_packing")
def harmonic_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packed(documents(spark, folder))


def packed(docs: DataFrame) -> DataFrame:
    """Each piece with a checksum in place of its ids, so that ids need not move."""
    pieces = packing.cut(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return packing.place(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"))


#: The key of the registered runs; a real corpus takes its own from a vault.
SURROGATE_KEY = "cohortline"


@query("op7_surrogates")
def surrogate_texts(spark: SparkSession, folder: str) -> DataFrame:
    found = surrogates.rewritten(documents(spark, folder), SURROGATE_KEY)
    return found.select("doc_id", "text", F.size("entities").cast("long").alias("n_entities"), "entities")


QUALITY_SQL = """
WITH t AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM t),
g AS (SELECT k, unnest(range(1, len(words) - 1)) AS i, words FROM w WHERE len(words) >= 3),
h AS (SELECT k, i, words[i:i + 2] AS words3 FROM g),
d AS (SELECT k, i, count(*) OVER (PARTITION BY k, words3) AS n FROM h),
r AS (SELECT k, count(DISTINCT p) AS n_repeat_words FROM (SELECT k, unnest([i, i + 1, i + 2]) AS p FROM d WHERE n > 1) GROUP BY 1),
m AS (SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words,
             CAST(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
             CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
             CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
      FROM w LEFT JOIN r USING (k)),
f AS (SELECT *, CAST((n_words < 50)::INT + 2 * (100 * n_repeat_words > 50 * n_words)::INT + 4 * (10 * n_symbols > 3 * n_words)::INT
      + 8 * (n_dup_lines >= 3 AND 2 * n_dup_lines > n_lines)::INT + 16 * (word_chars < 2 * n_words)::INT + 32 * (word_chars > 15 * n_words)::INT AS BIGINT) AS failures FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failures & 3 <> 0 AS base_failed, failures = 0 AS kept, failures
FROM f
"""


@query("op8_quality_ledger", QUALITY_SQL)
def quality_ledger(spark: SparkSession, folder: str) -> DataFrame:
    entries = quality.ledger(documents(spark, folder))
    base = quality.passes(quality.BASE)
    return entries.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~base).alias("base_failed"), (base & quality.passes(quality.STANDARD)).alias("kept"), "failures",
    )


@query("op6_toxicity")
def toxicity_scores(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    weights = toxicity.fit(docs, read_table(spark, folder, "labels"))
    found = toxicity.scored(docs, weights)
    return found.select(
        "doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"),
    )


@query("op9_line_classes")
def line_classes(spark: SparkSession, folder: str) -> DataFrame:
    return line_dedup.classes(documents(spark, folder)).withColumnsRenamed({"class_key": "class_doc"})


PERSPECTIVES_SQL = """
WITH t AS (SELECT conv_id, turn, coalesce(nullif(trim(role), ''), 'unknown') AS speaker, coalesce(text, '') AS content FROM conversations),
e AS (SELECT conv_id, min(turn) AS low, max(turn) AS high FROM t GROUP BY 1),
v AS (SELECT DISTINCT conv_id, speaker AS perspective FROM t WHERE speaker <> 'system'),
s AS (SELECT t.*, perspective, low, high,
             CASE WHEN speaker = 'system' THEN 'context' WHEN speaker = perspective THEN 'assistant' ELSE 'user' END AS role
      FROM t JOIN v ON t.conv_id IS NOT DISTINCT FROM v.conv_id JOIN e ON t.conv_id IS NOT DISTINCT FROM e.conv_id),
h AS (SELECT *, CASE WHEN role = 'user' THEN speaker END AS name,
             '<|' || role || CASE WHEN role = 'user' THEN ' name=' || replace(replace(speaker, '<|', '<||'), '>', '\\>') ELSE '' END || '|>' || chr(10) AS head FROM s)
SELECT conv_id, perspective, turn, speaker, role, name, content, role = 'assistant' AS trained, turn IS NOT DISTINCT FROM low AS is_first,
       turn IS NOT DISTINCT FROM high AS is_last, head || replace(content, '<|', '<||') || '<|end|>' || chr(10) AS segment, CAST(length(head) AS BIGINT) AS content_start
FROM h
"""


@query("op10_perspectives", PERSPECTIVES_SQL)
def dialogue_perspectives(spark: SparkSession, folder: str) -> DataFrame:
    return perspectives.rotated(read_table(spark, folder, "conversations"))


TOP_K_SQL = """
WITH e AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
q AS (SELECT * FROM e WHERE vec_id % 100 = 0),
s AS (SELECT q.vec_id AS query_id, e.vec_id, CAST(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(e.v AS DOUBLE[])) AS BIGINT) AS score
      FROM q JOIN e ON q.vec_id <> e.vec_id AND len(q.v) = len(e.v))
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 10
"""


@query("op5_metric_top_k", TOP_K_SQL)
def metric_top_k(spark: SparkSession, folder: str) -> DataFrame:
    return metric_search.top_k(read_table(spark, folder, "embeddings"), F.col("vec_id") % 100 == 0)


LEAF_FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _manifest_sql(levels: int, top_levels: int) -> str:
    """The statement for sources of at most 16 ** levels rows, and at most 16 ** top_levels sources."""
    field = "CASE WHEN {0} IS NULL THEN '-' ELSE CAST(strlen({0}) AS VARCHAR) || ':' || {0} END"
    texts = ["CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)"]
    leaf = lambda text: "sha256(" + " || ".join(field.format(x) for x in [*texts, text]) + ")"
    crc = ("list_reduce(flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [ascii(c), -1, -1, -1, -1, -1, -1, -1, -1])), "
           "lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, 3988292384 * (a & 1)) END, CAST(4294967295 AS BIGINT))")
    parts = [f"""d AS (SELECT doc_id, source, {leaf('text')} AS leaf, CASE WHEN xor({crc}, 4294967295) % 5 = 0
             THEN {leaf(f"translate(text, '{UPPER}', '{LOWER}')")} ELSE {leaf('text')} END AS start FROM documents)""",
             "a0 AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM d)",
             "t0 AS (SELECT source AS g, pos, leaf AS h FROM a0)"]

    def tree(name: str, n: int) -> None:
        for i in range(n):
            parts.append(f"{name}s{i} AS (SELECT *, count(*) OVER (PARTITION BY g) AS n FROM {name}{i})")
            parts.append(f"""{name}r{i} AS (SELECT g, pos // 16 AS run, n, CASE WHEN n = 1 THEN any_value(h) ELSE sha256(string_agg(h, '' ORDER BY pos)) END AS h,
                         CASE WHEN n = 1 THEN [] ELSE list(h ORDER BY pos) END AS hs FROM {name}s{i} GROUP BY 1, 2, 3)""")
            parts.append(f"{name}{i + 1} AS (SELECT g, run AS pos, h FROM {name}r{i})")

    def path(name: str, n: int, rows: str, group: str, out: str) -> None:
        """The siblings and the hash of ``node`` level by level, from ``pos`` upwards."""
        for i in range(n):
            parts.append(f"""{out}{i + 1} AS (SELECT x.* EXCLUDE (pos, proof, node), x.pos // 16 AS pos,
                proof || array_to_string(hs[:x.pos % 16], '') || array_to_string(hs[x.pos % 16 + 2:], '') AS proof,
                CASE WHEN len(hs) = 0 THEN node ELSE sha256(array_to_string(hs[:x.pos % 16], '') || node || array_to_string(hs[x.pos % 16 + 2:], '')) END AS node
                FROM {rows if i == 0 else f'{out}{i}'} x JOIN {name}r{i} r ON x.{group} IS NOT DISTINCT FROM r.g AND r.run = x.pos // 16)""")

    tree("t", levels)
    parts.append(f"u AS (SELECT g AS source, h AS subroot, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS place FROM t{levels})")
    parts.append("v0 AS (SELECT 0 AS g, place AS pos, subroot AS h FROM u)")
    tree("v", top_levels)
    parts.append("b0 AS (SELECT *, '' AS proof, start AS node FROM a0)")
    path("t", levels, "b0", "source", "b")
    parts.append(f"c0 AS (SELECT b.* EXCLUDE (pos), 0 AS top, u.place AS pos, u.subroot FROM b{levels} b JOIN u ON b.source IS NOT DISTINCT FROM u.source)")
    path("v", top_levels, "c0", "top", "c")
    return f"""WITH {", ".join(parts)}
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, node AS folded_root, node = root AS verified
FROM c{top_levels} CROSS JOIN (SELECT h AS root FROM v{top_levels})"""


@query("op11_merkle_manifest", _manifest_sql(5, 3))
def merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents").select(*LEAF_FIELDS)
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    fields = [F.translate("text", UPPER, LOWER) if c == "text" else F.col(c) for c in LEAF_FIELDS]
    found = merkle.manifest(docs.withColumn("altered", F.when(tampered, merkle.leaf(*fields))), LEAF_FIELDS, keep=["altered"])
    root = merkle.folded(F.coalesce("altered", "leaf"), F.col("witness"))
    return found.select("doc_id", "leaf", "subroot", "root", merkle.digest(merkle.siblings(F.col("witness"))).alias("proof_sha256"),
                        root.alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))


HARD_NEGATIVES_SQL = """
WITH e AS (SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, embedding FROM embeddings
           WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
v AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM e),
s AS (SELECT a.vec_id AS anchor_id, c.vec_id AS other, a.label = c.label AS same, CAST(list_dot_product(a.v, c.v) AS BIGINT) AS score
      FROM v a JOIN v c ON a.vec_id <> c.vec_id AND len(a.v) = len(c.v) WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other) AS INTEGER) AS rank,
       other AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
QUALIFY rank <= 5
"""


@query("op13_hard_negatives", HARD_NEGATIVES_SQL)
def mined_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(read_table(spark, folder, "embeddings"), F.col("vec_id") % 100 == 0, label)


URL_RULES = [
    url_rules.ListRule("net", "/", "block"), url_rules.ListRule("example.net", "/en/", "allow"),
    url_rules.ListRule("example.com", "/de/", "block"), url_rules.ListRule("org", "/fr/", "allow"),
]
URL_SQL = """
WITH u AS (SELECT row_number() OVER () AS k, page_id, url, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'UPPER', 'LOWER') AS host,
             coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
w AS (SELECT *, list_transform(regexp_extract_all(host, '[^./:@_-]+'), lambda x: 'h:' || x) AS hs,
             list_transform(regexp_extract_all(translate(path, 'UPPER', 'LOWER'), '[^./:@_-]+'), lambda x: 'p:' || x) AS ps FROM u),
b AS (SELECT doc_id, bool_or(coalesce(quality = 0, false) OR coalesce(toxic = 1, false)) AS bad FROM labels
      WHERE doc_id IS NOT NULL AND (quality IS NOT NULL OR toxic IS NOT NULL) GROUP BY 1),
t AS (SELECT list_sort(list_distinct(list_concat(list_reverse(hs)[:6], ps[:6]))) AS items, bad
      FROM (SELECT DISTINCT page_id, url, hs, ps FROM w) JOIN b ON page_id = doc_id),
m AS (SELECT items, bad, unnest(range(1, 1 << len(items))) AS mask FROM t),
c AS (SELECT list_filter(items, lambda x, i: (mask >> (i - 1)) & 1 = 1) AS s, count(*) AS n, count(*) FILTER (bad) AS hits FROM m GROUP BY 1),
r AS (SELECT s, hits / n AS confidence FROM c WHERE hits >= greatest(12, (SELECT ceil(0.001 * count(*)) FROM t)) AND hits / n >= 0.6),
x AS (SELECT * FROM r WHERE NOT EXISTS (FROM r q WHERE len(q.s) < len(r.s) AND list_has_all(r.s, q.s))),
h AS (SELECT k, array_to_string(arg_max(s, (confidence, array_to_string(s, ' '))), ' ') AS mined FROM w JOIN x ON list_has_all(list_concat(hs, ps), s) GROUP BY 1),
l AS (SELECT * FROM (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')) v(rule_host, rule_path, says)),
f AS (SELECT k, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule, arg_max(says, length(rule_host || rule_path)) AS says
      FROM u JOIN l ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY 1)
SELECT page_id, host, path, rule, coalesce(says, CASE WHEN mined IS NULL THEN 'allow' ELSE 'block' END) AS verdict, mined
FROM u LEFT JOIN f USING (k) LEFT JOIN h USING (k)
""".replace("UPPER", UPPER).replace("LOWER", LOWER)


def bad_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Ids of labelled rows; bad are those of low quality and toxic ones."""
    labels = read_table(spark, folder, "labels").where("doc_id IS NOT NULL AND (quality IS NOT NULL OR toxic IS NOT NULL)")
    bad = F.coalesce(F.col("quality") == 0, F.lit(False)) | F.coalesce(F.col("toxic") == 1, F.lit(False))
    return labels.groupBy(F.col("doc_id").alias("page_id")).agg(F.max(bad).alias("bad"))


@query("op12_url_rules", URL_SQL)
def url_verdicts(spark: SparkSession, folder: str) -> DataFrame:
    return url_rules.judged(read_table(spark, folder, "pages").select("page_id", "url"), bad_pages(spark, folder), URL_RULES)
