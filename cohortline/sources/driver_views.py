"""The star-schema test tables seen as linked study tables.

customer = patients, lineitem with orders = diagnoses and dispensings, orders = encounters,
events = laboratory tests.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortline.sources.tables import Rule

# fixed values: calendar of the test data
HISTORY_SPLIT = "1996-01-01"
STUDY_END = "1999-12-31"

# fixed values: codebook over the three-digit codes and drug classes of the test data
CODEBOOK = [
    Rule("dx_mi", "^00[0-1]"), Rule("dx_chf", "^00[2-3]"), Rule("dx_copd", "^00[4-5]"),
    Rule("dx_dm_com0", "^00[6-7]"), Rule("dx_dm_com1", "^008"),
    Rule("dx_liver_mild", "^009|^019"), Rule("dx_liver_modsev", "^020"),
    Rule("dx_cancer", "^02[1-3]"), Rule("dx_cancer_mets", "^19[6-9]"),
    Rule("dx_pvd", "^02[4-5]"), Rule("dx_cbd", "^02[6-7]"), Rule("dx_dementia", "^02[8-9]"), Rule("dx_paralysis", "^05[0-1]"),
    Rule("dx_crf", "^05[2-3]"), Rule("dx_ulcers", "^05[4-5]"), Rule("dx_ra", "^05[6-7]"), Rule("dx_aids", "^058"),
    Rule("dx_stroke_embo", "^06[0-2]"), Rule("dx_asthma", "^06[3-5]"), Rule("dx_infection_resp", "^06[6-9]"),
    Rule("dx_infection_viral", "^07[0-2]"), Rule("dx_sle", "^07[3-4]"), Rule("dx_spa", "^07[5-6]"), Rule("dx_psa", "^07[7-8]"),
    Rule("dx_ibd", "^079|^08[0-1]"), Rule("dx_ms", "^08[2-4]"),
    Rule("rx_av", "^2[.][1-3]$"), Rule("rx_ab", "^2[.][4-6]$"), Rule("rx_statin", "^2[.]1[0-2]$"),
    Rule("rx_gc", "^2[.]7$"), Rule("rx_immunsupp", "^2[.]8$"), Rule("rx_ac", "^2[.]9$"), Rule("rx_am", "^2[.]0$"),
    Rule("rx_bb", "^2[.][1-2]$"), Rule("rx_ccb", "^2[.]4$"), Rule("rx_acei", "^2[.]10$"), Rule("rx_arb", "^2[.]11$"),
    Rule("rx_dig", "^2[.]5$"),
]
ITEM_CODEBOOK = [Rule("it_rif", "^rif[ai]0"), Rule("it_iso", "^ison"), Rule("it_oth", "^pyra|^etha|^stre")]


def _read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _source(priority: Column) -> Column:
    return (
        F.when(priority.startswith("1") | priority.startswith("2"), "1.IP")
        .when(priority.startswith("3"), "2.AE")
        .when(priority.startswith("4"), "3.SO")
        .otherwise("4.GO")
    )


def patients(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("c_custkey")
    day = lambda start, n: F.date_add(F.to_date(F.lit(start)), n.cast("int"))
    second = day("1999-01-22", k % 120 + k % 10)
    return _read(spark, folder, "customer").select(
        k.alias("patient_id"),
        (16 + (k % 7) * 10).cast("int").alias("age"),
        F.when(k % 50 == 0, "U").when(k % 2 == 0, "F").otherwise("M").alias("sex"),
        F.when(k % 3 == 0, 0).otherwise(1).alias("vaccinated"),
        F.when(k % 3 == 1, "BrandA").when(k % 3 == 2, "BrandB").when(k % 9 == 0, "BrandA").alias("brand_1st"),
        F.when(k % 40 == 1, "BrandB").when(k % 3 == 1, "BrandA").when(k % 3 == 2, "BrandB").alias("brand_2nd"),
        day("1999-01-01", k % 120).alias("index_date"),
        second.alias("index_date2"),
        F.when((k % 3 != 0) | (k % 9 == 0),
               day("1999-01-01", k % 120 + F.when(k % 9 == 0, 200).otherwise(0))).alias("date_1st"),
        F.when(k % 3 != 0, second).alias("date_2nd"),
        F.when(k % 17 == 0, day("1999-01-15", k % 700)).alias("death_date"),
    )


def _lines(spark: SparkSession, folder: str) -> DataFrame:
    lines = _read(spark, folder, "lineitem")
    orders = _read(spark, folder, "orders")
    return lines.join(orders, lines.l_orderkey == orders.o_orderkey)


def dx(spark: SparkSession, folder: str) -> DataFrame:
    line = F.col("l_linenumber")
    return _lines(spark, folder).select(
        F.col("o_custkey").alias("patient_id"),
        (F.col("l_orderkey") * 10 + line).alias("rec_id"),
        F.to_date("l_shipdate").alias("date"),
        F.lpad((F.col("l_partkey") % 1000).cast("string"), 3, "0").alias("code"),
        _source(F.col("o_orderpriority")).alias("source"),
        F.when(line <= 3, "P").when(line == 4, "PS").otherwise("S").alias("ranking"),
    )


def dx_hist(spark: SparkSession, folder: str) -> DataFrame:
    old = dx(spark, folder).where(F.col("date") < F.to_date(F.lit(HISTORY_SPLIT)))
    return old.select("patient_id", "rec_id", "code", "source", "ranking",
                      F.date_format("date", "yyyy-MM").alias("date_ym"))


def dx_recent(spark: SparkSession, folder: str) -> DataFrame:
    return dx(spark, folder).where(F.col("date") >= F.to_date(F.lit(HISTORY_SPLIT)))


def rx_dense(spark: SparkSession, folder: str) -> DataFrame:
    p = F.col("l_partkey") % 8
    item = F.lit("rifa05")
    for code, name in enumerate(["ISON01", "RIFA01", "RIFI01", "PYRA03", "ETHA02", "STRE01", "RIFA05"]):
        item = F.when(p == code, name).otherwise(item)
    return _lines(spark, folder).select(
        F.col("o_custkey").alias("patient_id"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("rec_id"),
        item.alias("item_cd"),
        F.lit("5.1.9").alias("bnf"),
        F.col("l_quantity").cast("int").alias("days"),
        F.to_date("l_shipdate").alias("disp_date"),
    )


def rx(spark: SparkSession, folder: str) -> DataFrame:
    rec = F.col("rec_id")
    bnf = F.when(rec % 97 < 2, "5.1.9").otherwise(F.concat(F.lit("2."), (rec % 13).cast("string")))
    return rx_dense(spark, folder).withColumn("bnf", bnf)


def encounters(spark: SparkSession, folder: str) -> DataFrame:
    return _read(spark, folder, "orders").select(
        F.col("o_custkey").alias("patient_id"),
        F.col("o_orderkey").alias("rec_id"),
        F.to_date("o_orderdate").alias("date"),
        _source(F.col("o_orderpriority")).alias("source"),
    )


def lab(spark: SparkSession, folder: str) -> DataFrame:
    return _read(spark, folder, "events").select(
        F.col("user_id").alias("patient_id"),
        F.col("event_id").alias("rec_id"),
        F.date_sub(F.to_date("ts"), 9000).alias("date"),
        (210 + F.col("event_id") % 10).cast("string").alias("t_num"),
        F.when(F.col("event_type") == "error", "detected").otherwise("not detected").alias("result"),
    )
