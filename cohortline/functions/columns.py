"""Column helpers shared by the operators. All of them stay inside built-in expressions."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def conditional_update(df: DataFrame, column: str, condition: Column, value: Column) -> DataFrame:
    """Set ``column`` where ``condition`` is true; a column that does not exist yet starts NULL."""
    current = F.col(column) if column in df.columns else F.lit(None)
    return df.withColumn(column, F.when(condition, value).otherwise(current))


def blank_to_date(text: Column) -> Column:
    """A blank date string means the date is unknown."""
    return F.try_to_date(F.nullif(F.trim(text), F.lit("")))


def month_to_date(month: Column) -> Column:
    """Mid-month imputation of a ``yyyy-MM`` string."""
    return F.try_to_date(F.concat(month, F.lit("-15")))


def flag(condition: Column) -> Column:
    """1 where the condition holds, 0 where it does not or is unknown."""
    return F.coalesce(condition.cast("int"), F.lit(0))


def literal_prefixes(pattern: str) -> list[str] | None:
    """The letters and digits every match begins with, for each alternative of an anchored pattern; None if there are none."""
    if "(" in pattern or re.search(r"\[[^\]]*[|]", pattern):
        return None
    out = []
    for part in pattern.split("|"):
        found = re.match(r"\^([A-Za-z0-9]+)", part)
        prefix = found[1] if found else ""
        if found and part[found.end():found.end() + 1] in ("?", "*", "+", "{"):
            prefix = prefix[:-1]  # the last character may be absent
        if not prefix:
            return None
        out.append(prefix)
    return out


def find(column: Column, pattern: str, ignore_case: bool = False) -> Column:
    """Regex search anywhere in the string, as a predicate.

    An anchored pattern is preceded by the ranges its beginnings imply, which reach the scan and prune there. Where case does
    not matter these are the ranges of the first two characters in either case.
    """
    test = column.rlike(f"(?i){pattern}" if ignore_case else pattern)
    prefixes = literal_prefixes(pattern)
    if not prefixes:
        return test
    if ignore_case:
        prefixes = sorted({"".join(x) for p in prefixes for x in product(*[{c.lower(), c.upper()} for c in p[:2]])})
    return any_of([(column >= p) & (column < p[:-1] + chr(ord(p[-1]) + 1)) for p in prefixes]) & test


def with_levels(column: Column, levels: Sequence[str]) -> Column:
    """Categorical column: values outside ``levels`` become NULL."""
    return F.when(column.isin(list(levels)), column)


def relabel(column: Column, labels: Mapping) -> Column:
    """Map codes to labels; codes without a label become NULL."""
    out = F.lit(None).cast("string")
    for code, label in labels.items():
        out = F.when(column == F.lit(code), F.lit(label)).otherwise(out)
    return out


def columns_like(df: DataFrame, pattern: str) -> list[str]:
    """Column names that contain a match of ``pattern``."""
    return [c for c in df.columns if re.search(pattern, c)]


def cast_columns(df: DataFrame, columns: Sequence[str], kind: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast(kind) for c in columns})


def plain_names(df: DataFrame) -> DataFrame:
    """Replace every character that is not a letter, digit or underscore by an underscore."""
    names = [re.sub(r"\W", "_", c) for c in df.columns]
    return df.toDF(*[n if re.match(r"[A-Za-z_]", n) else f"x{n}" for n in names])


def align_union(first: DataFrame, second: DataFrame) -> DataFrame:
    """UNION ALL by position, under the names of ``first``."""
    return first.unionAll(second.toDF(*first.columns))


def fill_union(first: DataFrame, second: DataFrame) -> DataFrame:
    """UNION ALL by name; a column missing on one side is NULL there."""
    return first.unionByName(second, allowMissingColumns=True)


def shared_columns(left: DataFrame, right: DataFrame) -> list[str]:
    return [c for c in left.columns if c in right.columns]


def natural_join(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """Join on every column name the two sides share."""
    keys = shared_columns(left, right)
    if not keys:
        raise ValueError("the two sides share no column")
    return left.join(right, keys, how)


def age_group(age: Column, old: int = 60) -> Column:
    return F.when(age >= old, F.lit("Old")).when(age.isNotNull(), F.lit("Adult"))


def any_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def total(columns: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def present(df: DataFrame, names: Iterable[str], absent: Sequence[str] = ()) -> list[str]:
    """The names without those declared absent; any other that the frame lacks is an error."""
    wanted = [n for n in names if n not in absent]
    if missing := [n for n in wanted if n not in df.columns]:
        raise ValueError(f"columns are missing: {', '.join(missing)}; name them as absent to go on without them")
    return wanted
