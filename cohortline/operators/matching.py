"""Risk-set matching of controls to cases.

A case may draw from every patient with a control record of the same attributes, an age and a date
within the gaps. All cases with the same attributes, age and date share that pool, so pools are
built once per such *cell*; the number of cells is bounded by the calendar and the attribute values.
Pairs of case and control are never listed. Each pool has a hash order; a case draws K distinct numbers
below the pool's size by Floyd's method, one keyed hash for each, and takes the patients at these places.
That is a uniform draw without replacement, independent of the draws of all other cases, and the work is
linear in records and cases.

Pools overlap, so their rows are many times the records and are neither shuffled nor written. They are
made twice inside the tasks that hold the records: first they are counted by cell and by leading bits of
the hash, which gives the pool sizes and the bins that the drawn numbers fall into; then the members of
these bins alone are put in order.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortline.functions import fixed_values as V
from cohortline.functions.columns import find
from cohortline.functions.sizing import MAX_BROADCAST_BYTES, broadcast_if_small, cut_lineage, marked
from cohortline.operators.cohort import exclude

MAX_CELLS = 500_000
POOL_ROWS_PER_TASK = 4_000_000
#: Bins of a pool for each number drawn from it; a power of two is taken, of so many bits at most (whole hex digits).
BINS_PER_DRAW, MAX_BIN_BITS = 8, 20


def inpatient_records(dx: DataFrame, cutoff: Column, *more: str, key: str = "patient_id") -> DataFrame:
    """Inpatient records from the cut-off on, written once: cases, control pool and first events all come from them."""
    kept = dx.where((F.col("date") >= cutoff) & (F.col("source") == V.INPATIENT))
    return cut_lineage(kept.select(*dict.fromkeys([key, "rec_id", "date", "code", "source", "ranking", *more])))


def control_pool(dx: DataFrame, cohort: DataFrame, cases: DataFrame, cutoff: Column,
                 pattern: str = V.TUBERCULOSIS_DX, key: str = "patient_id") -> DataFrame:
    """Inpatient records from the cut-off on of eligible patients who are not cases, plus the
    records of cases before their first coded one (primary or not)."""
    inpatient = dx.where((F.col("date") >= cutoff) & (F.col("source") == V.INPATIENT))
    first = (
        inpatient.where(find(F.col("code"), pattern)).groupBy(key).agg(F.min("date").alias("_first"))
        .join(cases.select(key).distinct(), key, "left_semi")
    )
    eligible = cohort.select(key).distinct().join(first, key, "left")
    records = inpatient.join(eligible, key)
    return records.where(F.col("_first").isNull() | (F.col("date") < F.col("_first"))).drop("_first")


def first_event_window(records: DataFrame, condition: Column, key: str = "patient_id") -> DataFrame:
    """Records of each patient strictly before the patient's first record meeting the condition."""
    first = records.where(condition).groupBy(key).agg(F.min("date").alias("index_date"))
    return records.join(first, key).where(F.col("date") < F.col("index_date"))


def stack_case_control(cases: DataFrame, controls: DataFrame, name: str = "tb") -> DataFrame:
    """Cases and controls as one table; columns of one side only are NULL on the other."""
    return cases.withColumn(name, F.lit(1)).unionByName(controls.withColumn(name, F.lit(0)),
                                                        allowMissingColumns=True)


def _hash_text(*parts) -> Column:
    return F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]))


def draw_without_replacement(size: Column, k: int, *keys: Column) -> Column:
    """At most k distinct numbers from 0 to size - 1, chosen by the keys; every set of them is equally likely.

    For j from size - k on, a hashed number up to j is taken, or j itself if that number is taken already.
    """
    hashed = lambda j: F.conv(F.substring(_hash_text(*keys, j), 1, 12), 16, 10).cast("long")
    nothing = F.array().cast("array<bigint>")

    def step(taken: Column, j: Column) -> Column:
        number = hashed(j) % (j + 1)
        return F.array_append(taken, F.when(F.array_contains(taken, number), j).otherwise(number))

    last = size.cast("long")
    numbers = F.sequence(last - F.least(last, F.lit(k)), last - 1)
    return F.when(last > 0, F.aggregate(numbers, nothing, step)).otherwise(nothing)


def _spans(controls: DataFrame, var: str, age: str, age_gap: int, date: str, date_gap: int, key: str) -> DataFrame:
    """Rows (_var, _age, key, _text, _first, _last): the days, as numbers, on which a patient is in the pool of an age.

    A record counts from the day after the patient's record before it ceases to count, so that no day occurs twice.
    """
    own = controls.select(F.col(var).alias("_var"), F.explode(F.sequence(F.col(age) - age_gap, F.col(age) + age_gap)).alias("_age"),
                          F.unix_date(F.to_date(date)).alias("_day"), key).dropna(subset=["_var", "_day"]).distinct()
    before = F.lag("_day").over(Window.partitionBy("_var", "_age", key).orderBy("_day"))
    first = F.greatest(F.col("_day") - date_gap, before + (date_gap + 1))
    spans = own.select("_var", "_age", key, F.col(key).cast("string").alias("_text"), first.alias("_first"), (F.col("_day") + date_gap).alias("_last"))
    return spans.where(F.col("_first") <= F.col("_last"))


def _dealt(spans: DataFrame, date_gap: int, key: str) -> DataFrame:
    """Stretches of neighbouring days in one task, as many of them in each."""
    tasks = -(-spans.count() * (2 * date_gap + 1) // POOL_ROWS_PER_TASK)
    return spans.repartitionByRange(max(1, tasks), "_var", "_age", "_first", key)


def _members(spans: Sequence[DataFrame], cells: DataFrame, match_vars: Sequence[str], age: str, key: str) -> DataFrame:
    """Every (cell, patient) once, with all columns of the cell; nothing of this is shuffled for one match variable."""
    found = []
    for var, own in zip(match_vars, spans):
        days = own.withColumn("_on", F.explode(F.sequence("_first", "_last")))
        hit = (F.col(var) == F.col("_var")) & (F.col(age) == F.col("_age")) & (F.col("_day") == F.col("_on"))
        found.append(days.join(cells, hit).select(*cells.columns, key, "_text"))
    if len(found) == 1:
        return found[0]
    ids = reduce(DataFrame.unionAll, [f.select("_cell", key, "_text") for f in found])
    counts = ids.groupBy("_cell", key, "_text").agg(F.count(F.lit(1)).alias("_n"))
    return counts.where(F.col("_n") == len(found)).drop("_n").join(cells, "_cell")


def _member_hash() -> Column:
    return F.md5(F.concat_ws("|", "_prefix", "_text"))


def _binned(members: DataFrame) -> DataFrame:
    """Members with the bin of their hash: its leading bits, so that bins are in the order of hashes."""
    leading = F.conv(F.substring(_member_hash(), 1, MAX_BIN_BITS // 4), 16, 10).cast("long")
    members = members.withColumn("_lead", F.explode(F.array(leading)))  # computed once, however often it is used
    return members.withColumn("_bin", F.expr(f"shiftright(_lead, {MAX_BIN_BITS} - _bits)").cast("int"))


def _bitmaps(wanted: DataFrame, cells: DataFrame) -> DataFrame:
    """Cells with ``_words``: a bit for each bin, set for the wanted (cell, bin) rows, 64 to a number."""
    empty = cells.select("_cell", F.explode(F.sequence(F.lit(0), F.expr("shiftright(shiftleft(1, _bits) - 1, 6)"))).alias("_word"), F.lit(0).cast("long").alias("_bit"))
    one = wanted.select("_cell", F.expr("shiftright(_bin, 6)").alias("_word"), F.expr("shiftleft(1L, _bin & 63)").alias("_bit"))
    words = empty.unionAll(one).groupBy("_cell", "_word").agg(F.bit_or("_bit").alias("_bit"))
    lists = words.groupBy("_cell").agg(F.array_sort(F.collect_list(F.struct("_word", "_bit"))).alias("_list"))
    return cells.join(lists.select("_cell", F.col("_list._bit").alias("_words")), "_cell")


def match_controls(cohort: DataFrame, case_var: str = "tb", age: str = "age", age_gap: int = V.MATCH_AGE_GAP,
                   date: str = "date", date_gap: int = V.MATCH_DATE_GAP,
                   match_vars: Sequence[str] = tuple(V.MATCH_ON), k: int = V.CONTROLS_PER_CASE,
                   seed: int = V.MATCH_SEED, key: str = "patient_id") -> DataFrame:
    """K rows per case: slot m = 1..K, the control drawn for it (NULL when the pool is used up) and
    the pool size.

    The pool may hold the case's own earlier records; such self-matches take a slot and are dropped
    by :func:`match_long`.
    """
    names = [*match_vars, age, date]
    cases = cut_lineage(cohort.where(F.col(case_var) == 1).select(key, *names))
    controls = cohort.where(F.col(case_var) == 0)
    # A cell has some bins for each number that will be drawn from it.
    bits = F.least(F.lit(MAX_BIN_BITS), F.ceil(F.log2(F.count(F.lit(1)) * (k * BINS_PER_DRAW)))).cast("int")
    cells = cases.dropna(subset=names).groupBy(*names).agg(bits.alias("_bits"))
    cells = cells.withColumn("_prefix", F.concat_ws("|", F.lit(seed).cast("string"), *[F.col(n).cast("string") for n in names]))
    cells = cut_lineage(cells.withColumns({"_day": F.unix_date(F.to_date(date)), "_cell": F.monotonically_increasing_id()}))
    spans = [cut_lineage(_spans(controls, v, age, age_gap, date, date_gap, key)) for v in match_vars]
    dealt = lambda: [_dealt(s, date_gap, key) for s in spans]

    # The members of every pool, counted by bin.
    binned = _binned(_members(dealt(), broadcast_if_small(cells, MAX_CELLS), match_vars, age, key))
    counts = binned.groupBy("_cell", "_bin").agg(F.count(F.lit(1)).alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy("_cell").orderBy("_bin"))
    bins = cut_lineage(counts.select("_cell", "_bin", (upto - F.col("_n")).alias("_start"), "_n"))
    totals = bins.groupBy("_cell").agg(F.sum("_n").alias("pool_size"))
    totals = cells.select("_cell", *names).join(totals, "_cell")

    slots = cases.join(broadcast_if_small(totals, MAX_CELLS), names, "left").withColumn("pool_size", F.coalesce("pool_size", F.lit(0)))
    slots = slots.withColumn("_picks", draw_without_replacement(F.col("pool_size"), k, F.lit(seed), F.col(key), F.col(date)))
    slots = slots.withColumn("m", F.explode(F.sequence(F.lit(1), F.lit(k))))
    slots = cut_lineage(slots.withColumn("_rank", F.get("_picks", F.col("m") - 1)).drop("_picks"))

    # The bin of a drawn number is the last that starts at or before it.
    ranks = slots.where("_rank IS NOT NULL").select("_cell", "_rank").distinct()
    nothing = F.lit(None)
    both = bins.select("_cell", F.col("_start").alias("_at"), F.lit(0).alias("_drawn"), "_bin", "_start").unionAll(
        ranks.select("_cell", "_rank", F.lit(1), nothing.cast("int"), nothing.cast("long")))
    so_far = Window.partitionBy("_cell").orderBy("_at", "_drawn").rowsBetween(Window.unboundedPreceding, 0)
    last = lambda c: F.last(c, ignorenulls=True).over(so_far)
    located = both.select("_cell", "_drawn", F.col("_at").alias("_rank"), last("_bin").alias("_bin"), last("_start").alias("_start")).where("_drawn = 1")
    located = cut_lineage(located.select("_cell", "_rank", "_bin", (F.col("_rank") - F.col("_start") + 1).cast("int").alias("_place")))

    # Only members of bins with a drawn number leave their task; they are put into the order of hashes bin by bin.
    with_bits = cut_lineage(_bitmaps(located.select("_cell", "_bin").distinct(), cells))
    words = with_bits.agg(F.sum(F.size("_words"))).first()[0] or 0
    small = with_bits.count() <= MAX_CELLS and 8 * words <= MAX_BROADCAST_BYTES
    held = _binned(_members(dealt(), marked(with_bits, small), match_vars, age, key))
    held = held.where(F.expr("getbit(get(_words, shiftright(_bin, 6)), _bin & 63) = 1"))
    held = held.select("_cell", "_bin", key, F.unhex(_member_hash()).alias("_h"))
    in_bin = Window.partitionBy("_cell", "_bin").orderBy("_h", key)
    placed = held.select("_cell", "_bin", F.col(key).alias("control_id"), F.row_number().over(in_bin).alias("_place"))
    taken = located.join(placed, ["_cell", "_bin", "_place"]).select("_cell", "_rank", "control_id")
    drawn = slots.join(taken, ["_cell", "_rank"], "left")
    return drawn.select(F.col(key).alias("case_id"), *names, "pool_size", F.col("m").cast("int"), "control_id")


def match_wide(matched: DataFrame, k: int = V.CONTROLS_PER_CASE) -> DataFrame:
    """One row per case with columns M1..MK."""
    ids = [c for c in matched.columns if c not in ("m", "control_id")]
    wide = matched.groupBy(*ids).pivot("m", list(range(1, k + 1))).agg(F.first("control_id"))
    return wide.select(*ids, *[F.col(str(i)).alias(f"M{i}") for i in range(1, k + 1)])


def drawn_controls(matched: DataFrame) -> DataFrame:
    """Filled slots of :func:`match_controls` without self-matches; what wide and long again give."""
    return matched.where(F.col("control_id") != F.col("case_id"))


def match_long(wide: DataFrame, k: int = V.CONTROLS_PER_CASE) -> DataFrame:
    """Back to one row per drawn control, without empty slots and self-matches."""
    slots = [f"M{i}" for i in range(1, k + 1)]
    ids = [c for c in wide.columns if c not in slots]
    long = wide.unpivot(ids, slots, "m", "control_id")
    return long.where(F.col("control_id") != F.col("case_id"))


def attach_registry(matched: DataFrame, cohort: DataFrame, on: Sequence[str] = ("age", "sex"),
                    key: str = "patient_id") -> DataFrame:
    """Matched controls with their registry columns; the date stays the case's date."""
    renamed = matched.withColumnRenamed("control_id", key)
    return renamed.join(cohort, [*on, key], "left")


def match_summary(matched: DataFrame) -> DataFrame:
    """Distinct controls, and matched rows whose control is a case as well."""
    cases = matched.select(F.col("case_id").alias("_case")).distinct()
    rows = matched.join(cases, F.col("control_id") == F.col("_case"), "left")
    return rows.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_distinct("control_id").alias("n_controls"),
        F.count_distinct("case_id").alias("n_cases"),
        F.count("_case").alias("n_control_is_case"),
    )


def case_label(match: str = "match", key: str = "patient_id") -> Column:
    return (F.col(match) == F.col(key)).cast("int")


def drop_recent_sets(data: DataFrame, days: int = V.RISK_WINDOW_DAYS, match: str = "match",
                     case: str = "tb", onset: str = "onset_time") -> DataFrame:
    """Drop whole matched sets whose case had its onset within ``days`` of a dose."""
    recent = data.where((F.col(case) == 1) & (F.col(onset) < days)).select(match)
    return exclude(data, recent, match)
