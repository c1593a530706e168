"""Codebook rules as an index of code prefixes.

A rule names the beginnings of codes, as patterns such as ``^01[0-8]|^2[.]1$``. Each alternative stands for a few plain prefixes or
whole codes, with letters folded to lower case where case does not matter. The index has one small table for each length of
prefix, so a code finds all its rules by as many hash lookups as there are lengths, whatever the number of rules; patterns that
are no list of prefixes keep their regular expression.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field
from itertools import product

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortline.functions.columns import any_of

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Prefixes one pattern may stand for; a pattern of more keeps its regular expression.
MOST_PREFIXES = 2000
#: Rows (prefix, rules) of all lengths, about 100 bytes each, that are sent to all executors; the rules of further ones keep theirs.
MOST_ENTRIES = 200_000
#: Ranges that go before the lookup as a condition the scan can use.
MOST_RANGES = 64

_ATOM = re.compile(r"(?P<group>\[[^\]^\\]+\])|\\(?P<escaped>[^A-Za-z0-9])|(?P<plain>[A-Za-z0-9 _/-])")


def _characters(group: str) -> str:
    """The members of a bracket expression without escapes."""
    out, i = "", 0
    while i < len(group):
        if i + 2 < len(group) and group[i + 1] == "-":
            out += "".join(map(chr, range(ord(group[i]), ord(group[i + 2]) + 1)))
            i += 3
        else:
            out += group[i]
            i += 1
    return out


def prefixes(pattern: str) -> list[tuple[str, bool]] | None:
    """(text, whether it is the whole code) for all beginnings a pattern allows; None if it is no such list."""
    out: list[tuple[str, bool]] = []
    if re.search(r"\[[^\]]*[|$]", pattern):
        return None
    for part in pattern.split("|"):
        if not part.startswith("^"):
            return None
        body, whole = part[1:].removesuffix("$"), part.endswith("$")
        choices, at = [], 0
        while at < len(body):
            atom = _ATOM.match(body, at)
            if not atom:
                return None
            choices.append(_characters(atom["group"][1:-1]) if atom["group"] else atom["escaped"] or atom["plain"])
            at = atom.end()
            if at < len(body) and body[at] == "?":  # there or not
                choices[-1] = ["", *choices[-1]]
                at += 1
        count = 1
        for c in choices:
            count *= len(c)
        if not choices or count > MOST_PREFIXES:
            return None
        made = ["".join(x) for x in product(*choices)]
        if "" in made:
            return None
        out += [(x, whole) for x in made]
    return out


def folded(column: Column) -> Column:
    """A to Z in lower case, which is what patterns without case compare."""
    return F.translate(column, UPPER, LOWER)


def _after(prefix: str) -> str:
    return prefix[:-1] + chr(ord(prefix[-1]) + 1)


def _ranges(entries: Sequence[str], ignore_case: bool) -> list[tuple[str, str]]:
    """Disjoint ranges [low, high) of raw codes that cover all prefixes, ``MOST_RANGES`` at most."""
    for width in (8, 4, 2, 1):
        heads = {e[:width] for e in entries}
        if ignore_case:
            heads = {"".join(x) for h in heads for x in product(*[{c, c.upper()} if c in LOWER else {c} for c in h[:width]])} if width <= 2 else None
            if heads is None and not any(c in LOWER for e in entries for c in e[:width]):
                heads = {e[:width] for e in entries}
            if heads is None:
                continue
        merged: list[list[str]] = []
        for low, high in sorted((h, _after(h)) for h in heads):
            if merged and low <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], high)
            else:
                merged.append([low, high])
        if len(merged) <= MOST_RANGES or width == 1:
            return [(a, b) for a, b in merged]
    return []


@dataclass
class CodeIndex:
    """Rules told apart by number: prefixes of each length, whole codes, and patterns that are neither."""

    ignore_case: bool
    by_length: dict[int, dict[str, list[int]]] = field(default_factory=dict)
    exact: dict[str, list[int]] = field(default_factory=dict)
    patterns: list[tuple[int, str]] = field(default_factory=list)

    @classmethod
    def of(cls, patterns: Sequence[str], ignore_case: bool = True) -> CodeIndex:
        index, entries = cls(ignore_case), 0
        for number, pattern in enumerate(patterns):
            listed = prefixes(pattern)
            if listed is None or entries + len(listed) > MOST_ENTRIES:
                index.patterns.append((number, f"(?i){pattern}" if ignore_case else pattern))
                continue
            for text, whole in dict.fromkeys((x.lower() if ignore_case else x, w) for x, w in listed):
                table = index.exact if whole else index.by_length.setdefault(len(text), {})
                rules = table.setdefault(text, [])
                if number not in rules:
                    rules.append(number)
                    entries += 1
        return index

    def may_match(self, code: Column) -> Column | None:
        """A condition on the raw code that all matching codes meet, for the scan; None if there is none."""
        if self.patterns:
            return None
        entries = [*self.exact, *(p for table in self.by_length.values() for p in table)]
        ranges = _ranges(entries, self.ignore_case)
        return any_of([(code >= low) & (code < high) for low, high in ranges]) if ranges else None

    def _table(self, spark: SparkSession, entries: dict[str, list[int]], key: str, out: str) -> DataFrame:
        rows = pa.table({key: pa.array(entries, pa.string()), out: pa.array(entries.values(), pa.list_(pa.int32()))})
        return F.broadcast(spark.createDataFrame(rows))

    def matches(self, records: DataFrame, code: str, out: str = "_rule") -> DataFrame:
        """Each record once for every rule its code matches, with the rule's number in ``out``."""
        text = folded(F.col(code)) if self.ignore_case else F.col(code)
        condition = self.may_match(F.col(code))
        rows = (records if condition is None else records.where(condition)).withColumn("_text", text)
        found = []
        tables = [(F.substring("_text", 1, length), entries) for length, entries in sorted(self.by_length.items())]
        tables += [(F.col("_text"), self.exact)] if self.exact else []
        for i, (part, entries) in enumerate(tables):
            table = self._table(records.sparkSession, entries, f"_key{i}", f"_found{i}")
            rows = rows.join(table, part == F.col(f"_key{i}"), "left").drop(f"_key{i}")
            found.append(F.coalesce(f"_found{i}", F.array().cast("array<int>")))
        found += [F.when(F.col(code).rlike(p), F.array(F.lit(n))).otherwise(F.array().cast("array<int>")) for n, p in self.patterns]
        each = F.concat(*found) if len(found) > 1 else found[0]
        # a rule may be found by several of its prefixes
        return rows.withColumn(out, F.explode(F.array_distinct(each))).drop("_text", *[f"_found{i}" for i in range(len(tables))])
