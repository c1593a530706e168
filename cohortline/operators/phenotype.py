"""Codebook rules over diagnosis codes, drug classes and drug items."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortline.functions.code_index import CodeIndex
from cohortline.functions.columns import flag, present, total
from cohortline.functions.fixed_values import INDEX_SUPERSEDED_BY, INDEX_WEIGHTS
from cohortline.operators.timejoin import carried_overlap, in_reach
from cohortline.sources.tables import Rule

# rules that become columns of one aggregate
BLOCK_RULES = 1000


def blocks(rules: Sequence[Rule]) -> list[Sequence[Rule]]:
    """Rules in blocks that fit one aggregate, for codebooks of any length."""
    return [rules[i:i + BLOCK_RULES] for i in range(0, len(rules), BLOCK_RULES)]


def matched_rules(records: DataFrame, code: str, rules: Sequence[Rule]) -> DataFrame:
    """Each record once for every rule its code matches, with the rule's number in ``_rule``.

    One pass over the records; what it costs follows the matches, not the number of rules.
    """
    return CodeIndex.of([r.regex for r in rules]).matches(records, code)


def history_flags(records: DataFrame, anchors: DataFrame, rules: Sequence[Rule], code: str = "code",
                  key: str = "patient_id", anchor: str = "index_date", date: str = "date") -> DataFrame:
    """Anchor rows plus one 0/1 column per rule: a matching record strictly before the anchor.

    The earliest matching date per patient and rule decides, so one aggregate over the matches serves any number of anchors
    per patient.
    """
    out = anchors
    for block in blocks(rules):
        tagged = matched_rules(records.select(key, code, date), code, block)
        firsts = tagged.groupBy(key, "_rule").agg(F.min(date).alias("_first"))
        wide = firsts.groupBy(key).pivot("_rule", list(range(len(block)))).agg(F.min("_first"))
        wide = wide.toDF(key, *[f"_first_{r.name}" for r in block])
        flags = [flag(F.col(f"_first_{r.name}") < F.col(anchor)).alias(r.name) for r in block]
        out = out.join(wide, key, "left").select(*out.columns, *flags)
    return out


def episode_flags(records: DataFrame, anchors: DataFrame, rules: Sequence[Rule], code: str, lookback: int,
                  anchor_keys: Sequence[str], anchor: str = "index_date", inclusive: bool = False,
                  key: str = "patient_id", start: str = "disp_date", end: str = "end_date") -> DataFrame:
    """``anchor_keys`` plus one 0/1 column per drug rule for episodes overlapping the look-back."""
    out = None
    records = in_reach(records.select(key, code, start, end), anchors, lookback, anchor, start, end)
    for block in blocks(rules):
        tagged = matched_rules(records, code, block)
        # the latest end per patient, day and rule decides
        ends = tagged.groupBy(key, start, "_rule").agg(F.max(end).alias("_end"))
        names = [r.name for r in block]
        own = [F.when(F.col("_rule") == i, F.col("_end")).alias(n) for i, n in enumerate(names)]
        part = carried_overlap(ends, anchors, dict(zip(names, own)), lookback, anchor_keys, key, anchor, start, inclusive)
        out = part if out is None else out.join(part, list(anchor_keys))
    return anchors.select(*anchor_keys).distinct() if out is None else out


def comorbidity_index(df: DataFrame, name: str = "cci", absent: Sequence[str] = ()) -> DataFrame:
    """Weighted sum of the 0/1 history flags; flags named in ``absent`` count 0, any other must be there."""
    terms = []
    for column in present(df, INDEX_WEIGHTS, absent):
        term = F.col(column) * INDEX_WEIGHTS[column]
        graver = INDEX_SUPERSEDED_BY.get(column)
        if graver and graver not in absent:
            term = term * (1 - F.col(graver))
        terms.append(term)
    return df.withColumn(name, total(terms).cast("int"))
