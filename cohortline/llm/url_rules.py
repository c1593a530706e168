"""URL verdicts from listed rules and from association rules mined from labels.

A listed rule names a host with all its subdomains and the beginning of a path; the longest that fits decides. Where none fits,
mined rules do: the tokens of labelled URLs and a mark on bad ones are the baskets of FP-growth, and a set of tokens becomes a
rule when enough bad URLs hold it and a large enough share of all that hold it are bad. A rule that holds a shorter one adds
nothing to a verdict and goes.

Rules match through an inverted index: each stands under its rarest token, a URL looks up its own tokens, and a rule found
there fits if the URL has all its other tokens as well. Everything is a built-in expression or Spark's FP-growth.

Tokens are the words of the host, ``h:`` before them, and of the path, ``p:`` before them, letters A to Z in lower case. Rules
are mined from all of them, and looked up by all of them. The sets grow with the power of the tokens mined together, so tokens
that cannot add a shortest rule are settled before FP-growth: those on too few bad URLs, those that are rules by themselves, those on
all labelled URLs, and of tokens on the very same URLs all but one, whose rules are then written for each of them. Equal URLs are told by
their number and 128 bits of hashes of their rows.

Defined cases: a URL that is null or has no ``://`` has an empty host and path, no tokens and no rule; labels join by id, and
of several labels of one id any bad one counts; labels that are null, and null ids, teach nothing; repeated rows teach once and
are judged each; without labels nothing is mined; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from math import ceil

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortline.functions.sizing import cut_lineage, drop_cut, marked

#: Bad URLs that must hold a set of tokens: this share of the labelled ones, and so many at least.
SUPPORT, LEAST_ROWS = 0.001, 12
#: Share of bad ones among the labelled URLs that hold a set.
CONFIDENCE = 0.6
#: Index rows, some hundred bytes each, and hits of 40 bytes that are broadcast; more are joined by a shuffle.
BROADCAST_RULES, BROADCAST_HITS = 50_000, 500_000
BAD = "="
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class ListRule:
    """A host with its subdomains, the beginning of a path, and what becomes of URLs there."""

    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


def _part(url: Column, group: int) -> Column:
    return F.coalesce(F.regexp_extract(url, "^(?s:.*?)://([^/?#]*)([^?#]*)", group), F.lit(""))


def host_of(url: Column) -> Column:
    return F.translate(_part(url, 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return _part(url, 2)


def _words(text: Column, kind: str) -> Column:
    found = F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit("([^./:@_-]+)"), F.lit(1))
    return F.transform(found, lambda x: F.concat(F.lit(kind), x))


def tokens(host: Column, path: Column) -> Column:
    return F.array_distinct(F.concat(_words(host, "h:"), _words(path, "p:")))


def listed(host: Column, path: Column, rules: Sequence[ListRule]) -> Column:
    """The longest rule that fits, as a struct of length, text and verdict; null without one."""
    fitting = []
    for r in rules:
        fits = ((host == r.host) | host.endswith(f".{r.host}")) & path.startswith(r.path)
        fitting.append(F.when(fits, F.struct(F.lit(len(r.text)).alias("length"), F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict"))))
    return F.array_max(F.array(*fitting))


def _subsets(items: Column) -> Column:
    """All sets of at least one and not all of the items."""
    many = F.sequence(F.lit(1).cast("long"), F.pow(F.lit(2), F.size(items)).cast("long") - 2)
    each = F.transform(many, lambda m: F.filter(items, lambda x, i: F.getbit(m, i) == 1))
    return F.when(F.size(items) > 1, each)


def mined(urls: DataFrame, bad: DataFrame, key: str, url: str, support: float = SUPPORT, least_rows: int = LEAST_ROWS,
          confidence: float = CONFIDENCE) -> DataFrame | None:
    """Rules (items, confidence, token): sorted sets of tokens, and the rarest token of each; None without labels.

    ``bad`` has the id in ``key`` and a boolean ``bad``.
    """
    known = urls.select(key, url).distinct().join(bad, key)
    labelled = cut_lineage(known.select(F.monotonically_increasing_id().alias("row"), tokens(host_of(F.col(url)), path_of(F.col(url))).alias("items"), F.coalesce("bad", F.lit(False)).alias("bad")))
    rows = labelled.count()
    if not rows:
        return None
    least = max(least_rows, ceil(support * rows))
    held = labelled.select("row", "bad", F.explode("items").alias("token"))
    same_rows = [F.bit_xor(F.xxhash64("row", F.lit(i))).alias(f"rows{i}") for i in range(2)]
    single = held.groupBy("token").agg(F.count(F.lit(1)).alias("freq"), F.count_if("bad").alias("hits"), *same_rows)
    single = cut_lineage(single.where(F.col("hits") >= least).withColumn("confidence", F.col("hits") / F.col("freq")))
    short = single.where(F.col("confidence") >= confidence).select(F.array("token").alias("items"), "confidence")
    left = single.where((F.col("confidence") < confidence) & (F.col("freq") < rows))
    left = cut_lineage(left.groupBy("freq", "rows0", "rows1").agg(F.min("token").alias("token"), F.collect_list("token").alias("twins")).select("token", "twins"))
    kept = held.join(marked(left.select("token"), left.count() <= BROADCAST_RULES), "token").groupBy("row").agg(F.collect_list("token").alias("kept"))
    mark = F.when(F.col("bad"), F.array(F.lit(BAD))).otherwise(F.array().cast("array<string>"))
    baskets = cut_lineage(labelled.select("row", "bad").join(kept, "row", "left").select(F.concat(F.coalesce("kept", F.array().cast("array<string>")), mark).alias("items")))
    # Spark rounds the share up to a count again; half a row less keeps it at ``least``.
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, (least - 0.5) / rows)).fit(baskets)
    sets = cut_lineage(model.freqItemsets.select(F.array_sort("items").alias("items"), "freq"))
    alone = sets.where(~F.array_contains("items", BAD))
    of_bad = sets.where(F.array_contains("items", BAD) & (F.size("items") > 1)).select(F.array_remove("items", BAD).alias("items"), F.col("freq").alias("hits"))
    found = of_bad.join(alone, "items").withColumn("confidence", F.col("hits") / F.col("freq")).where(F.col("confidence") >= confidence)
    found = cut_lineage(found.select("items", "confidence"))
    holding = found.select("items", F.explode(_subsets(F.col("items"))).alias("part"))
    longer = holding.join(found.select(F.col("items").alias("part")), "part", "left_semi").select("items").distinct()
    # A rule holds for every choice of twins.
    chosen = found.join(longer, "items", "left_anti").withColumn("token", F.explode("items")).join(left, "token").groupBy("items", "confidence").agg(F.collect_list("twins").alias("choices"))
    nothing = F.array(F.array().cast("array<string>"))
    spread = F.aggregate("choices", nothing, lambda made, twins: F.flatten(F.transform(made, lambda m: F.transform(twins, lambda t: F.array_append(m, t)))))
    every = short.unionAll(chosen.select(F.explode(F.transform(spread, lambda s: F.array_sort(s))).alias("items"), "confidence"))
    under = every.withColumn("token", F.explode("items")).join(single.select("token", "freq"), "token")
    rules = cut_lineage(under.groupBy("items", "confidence").agg(F.min_by("token", F.struct("freq", "token")).alias("token")))
    drop_cut(labelled, single, left, baskets, sets, found)
    return rules


def judged(urls: DataFrame, bad: DataFrame, rules: Sequence[ListRule], key: str = "page_id", url: str = "url", **options) -> DataFrame:
    """Rows (key, host, path, rule, verdict, mined): ``mined`` has the tokens of the surest mined rule that fits, if any."""
    host, path = host_of(F.col(url)), path_of(F.col(url))
    parsed = cut_lineage(urls.select(F.col(key).alias("key"), host.alias("host"), path.alias("path")).withColumn("row", F.monotonically_increasing_id()))
    learned = mined(urls, bad, key, url, **options)
    best = listed(F.col("host"), F.col("path"), rules)
    if learned is None:
        rows = parsed.withColumn("mined", F.lit(None).cast("string"))
    else:
        index = learned.groupBy("token").agg(F.collect_list(F.struct("confidence", "items")).alias("under"))
        index = cut_lineage(index)
        held = parsed.select("row", tokens(F.col("host"), F.col("path")).alias("tokens")).withColumn("token", F.explode("tokens"))
        looked = held.join(marked(index, index.count() <= BROADCAST_RULES), "token")
        fitting = F.filter("under", lambda r: F.size(F.array_except(r["items"], F.col("tokens"))) == 0)
        named = F.transform(fitting, lambda r: F.struct(r["confidence"].alias("confidence"), F.array_join(r["items"], " ").alias("text")))
        hits = looked.select("row", F.array_max(named).alias("hit")).where(F.col("hit").isNotNull()).groupBy("row").agg(F.max("hit").alias("hit"))
        hits = cut_lineage(hits.select("row", F.col("hit.text").alias("mined")))
        rows = parsed.join(marked(hits, hits.count() <= BROADCAST_HITS), "row", "left")
    rows = rows.withColumn("best", best)
    own = F.when(F.col("mined").isNotNull(), "block").otherwise("allow")
    return rows.select(F.col("key").alias(key), "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", own).alias("verdict"), "mined")
