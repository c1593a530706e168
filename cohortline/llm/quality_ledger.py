"""Quality rules as a ledger: every rule is evaluated once, its verdict is a bit, its measurements are kept.

``ledger`` adds the measurements and one integer of failure bits to each document. A policy is a version with the rules that
count and the number of failures it forgives; applying another policy, or asking what a rule costs, reads the bits and never
the text again.

Everything is DataFrame expressions: no Python code runs on the executors. Repeated windows are found by sorting
(hash, position) pairs inside a row, so no word leaves its document.

Defined cases: a null text has no words; empty texts fail the rules with a lower bound; repeated rows are measured each;
other columns stay, and columns named as an output are replaced.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortline.llm.common import free_name

#: Fixed by the measurements' definition: characters between words, and symbols.
SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 3


@dataclass(frozen=True)
class Rule:
    """A named test over measurement columns; true or null means failure."""

    name: str
    fails: Callable[[], Column]


#: The order is the bit order; new rules are added at the end so that stored bits keep their meaning.
RULES = (
    Rule("few_words", lambda: F.col("n_words") < 50),
    Rule("repetition", lambda: 100 * F.col("n_repeat_words") > 50 * F.col("n_words")),
    Rule("symbols", lambda: 10 * F.col("n_symbols") > 3 * F.col("n_words")),
    Rule("duplicate_lines", lambda: (F.col("n_dup_lines") >= 3) & (2 * F.col("n_dup_lines") > F.col("n_lines"))),
    Rule("short_words", lambda: F.col("word_chars") < 2 * F.col("n_words")),
    Rule("long_words", lambda: F.col("word_chars") > 15 * F.col("n_words")),
)


@dataclass(frozen=True)
class Policy:
    """Rules that count, by name, and how many of their failures are forgiven."""

    version: str
    rules: tuple[str, ...]
    forgiven: int = 0


BASE = Policy("base", ("few_words", "repetition"))
STANDARD = Policy("standard-1", tuple(r.name for r in RULES))


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents with n_words, word_chars, n_symbols, n_lines, n_dup_lines and n_repeat_words.

    A word is a run without space, tab, newline, vertical tab, form feed or return; lines end at newlines and count if they
    hold a word; a line is a duplicate if an earlier one is equal; a repeated word lies in a 3-word window that occurs
    twice or more in the text.
    """
    outputs = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
    kept = [c for c in docs.columns if c.lower() not in outputs]
    names, taken = {}, [*kept, *outputs]
    for part in ("words", "lines", "pairs", "places"):
        names[part] = free_name(f"_{part}", taken)
        taken.append(names[part])
    words, lines, pairs, places = (F.col(names[p]) for p in ("words", "lines", "pairs", "places"))
    source = F.coalesce(F.col(text), F.lit(""))
    solid = F.translate(source, SPACE, "")
    spaced = F.translate(source, SPACE, " " * len(SPACE))
    split = F.filter(F.split(spaced, " "), lambda x: x != "")
    per_line = F.filter(F.split(source, "\n"), lambda x: F.translate(x, SPACE, "") != "")
    starts = F.sequence(F.lit(1), F.size(words) - (WINDOW - 1))
    windows = F.transform(starts, lambda i: F.struct(F.xxhash64(*[F.element_at(words, i + k) for k in range(WINDOW)]).alias("h"), i.alias("i")))
    at = lambda i: F.get(pairs, i)["h"]
    twice = F.filter(pairs, lambda x, i: F.coalesce(at(i - 1) == x["h"], F.lit(False)) | F.coalesce(at(i + 1) == x["h"], F.lit(False)))
    gaps = F.aggregate(
        places, F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).alias("last")),
        lambda a, p: F.struct((a["n"] + F.least(F.lit(WINDOW), p - a["last"])).cast("long").alias("n"), p.alias("last")),
        lambda a: a["n"],
    )
    with_words = docs.select(
        *kept,
        F.length(solid).cast("long").alias("word_chars"),
        (F.length(source) - F.length(F.translate(source, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        split.alias(names["words"]), per_line.alias(names["lines"]),
    )
    empty = F.array().cast("array<struct<h:bigint,i:int>>")
    with_pairs = with_words.select(
        *kept, "word_chars", "n_symbols",
        F.size(words).cast("long").alias("n_words"),
        F.size(lines).cast("long").alias("n_lines"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        F.sort_array(F.when(F.size(words) >= WINDOW, windows).otherwise(empty)).alias(names["pairs"]),
    )
    with_places = with_pairs.withColumn(names["places"], F.sort_array(F.transform(twice, lambda x: x["i"])))
    return with_places.withColumn("n_repeat_words", gaps).select(*kept, *outputs)


def ledger(docs: DataFrame, text: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """The measured documents with ``failures``: bit i is set if rule i fails."""
    bits = F.lit(0).cast("long")
    for i, rule in enumerate(rules):
        bits = bits.bitwiseOR(F.when(F.coalesce(rule.fails(), F.lit(True)), F.lit(1 << i)).otherwise(F.lit(0)).cast("long"))
    return measured(docs, text).withColumn("failures", bits)


def mask(policy: Policy, rules: Sequence[Rule] = RULES) -> int:
    known = {r.name: 1 << i for i, r in enumerate(rules)}
    if missing := [x for x in policy.rules if x not in known]:
        raise ValueError(f"policy {policy.version} names unknown rules: {missing}")
    return sum(known[x] for x in policy.rules)


def counted(policy: Policy, rules: Sequence[Rule] = RULES, without: str | None = None) -> Column:
    """Failures of the policy's rules, one rule left out if asked for."""
    bits = mask(policy, rules)
    if without is not None:
        bits &= ~mask(Policy(policy.version, (without,)), rules)
    return F.bit_count(F.col("failures").bitwiseAND(F.lit(bits).cast("long")))


def passes(policy: Policy, rules: Sequence[Rule] = RULES) -> Column:
    return counted(policy, rules) <= policy.forgiven


def ablation(entries: DataFrame, policy: Policy, rules: Sequence[Rule] = RULES) -> DataFrame:
    """For each rule of the policy: documents that fail it, that fail nothing else, and that the policy keeps without it.

    One aggregate by failure bits, of which there are at most 2 to the number of rules; texts are not read. An empty table
    gives zeros.
    """
    groups = entries.groupBy("failures").count()
    sums = []
    for name in policy.rules:
        bit = mask(Policy(policy.version, (name,)), rules)
        own = F.col("failures").bitwiseAND(F.lit(mask(policy, rules)).cast("long"))
        sums.append(F.struct(
            F.lit(policy.version).alias("policy"), F.lit(name).alias("rule"),
            F.sum(F.when(own.bitwiseAND(F.lit(bit).cast("long")) != 0, F.col("count")).otherwise(0)).alias("failing"),
            F.sum(F.when(own == bit, F.col("count")).otherwise(0)).alias("failing_alone"),
            F.sum(F.when(counted(policy, rules, without=name) <= policy.forgiven, F.col("count")).otherwise(0)).alias("kept_without"),
        ))
    rows = groups.agg(F.array(*sums).alias("r")).select(F.explode("r").alias("r")).select("r.*")
    return rows.select("policy", "rule", *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("failing", "failing_alone", "kept_without")])


def common_bits(entries: DataFrame, by: str) -> DataFrame:
    """For each value of ``by``: bits that some document fails, and bits that all documents fail."""
    return entries.groupBy(by).agg(F.bit_or("failures").alias("any_fails"), F.bit_and("failures").alias("all_fail"), F.count("*").alias("n_docs"))
