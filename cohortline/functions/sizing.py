"""Size-checked broadcast and lineage cuts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: What a table may take when it is sent to all executors, by the width of its row type.
MAX_BROADCAST_BYTES = 128 << 20


#: Bytes a value takes in a row, by its type; others take eight.
WIDTHS = {"string": 20, "binary": 100, "boolean": 1, "tinyint": 1, "smallint": 2, "int": 4, "float": 4, "date": 4}


def row_bytes(df: DataFrame) -> int:
    """What a row takes, about; an array counts as four values."""
    width = lambda kind: 4 * width(kind[6:-1]) if kind.startswith("array<") else WIDTHS.get(kind, 8)
    return 8 + sum(width(kind) for _, kind in df.dtypes)


def checked_small(df: DataFrame, max_rows: int, max_bytes: int = MAX_BROADCAST_BYTES) -> tuple[DataFrame, bool]:
    """Tell whether ``df`` has at most ``max_rows`` rows and ``max_bytes`` bytes.

    At most one row more is written to the shared folder. If that is all of it, the written table stands for ``df`` from here on;
    if not, the caller needs an exact plan for ``df`` itself.
    """
    most = min(max_rows, max_bytes // row_bytes(df))
    some = cut_lineage(df.limit(most + 1))
    if some.count() <= most:
        return some, True
    drop_cut(some)
    return df, False


def marked(df: DataFrame, fits: bool) -> DataFrame:
    """Broadcast what was checked to be small; leave the rest to the planner."""
    return F.broadcast(df) if fits else df


def broadcast_if_small(df: DataFrame, max_rows: int) -> DataFrame:
    return marked(*checked_small(df, max_rows))


def shared_folder(spark: SparkSession) -> str:
    """This application's folder below the one the cluster names in ``spark.checkpoint.dir``.

    A session without that setting uses its warehouse, unless that is a folder of the driver's machine which the executors of a
    cluster do not see.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        base = spark.conf.get("spark.sql.warehouse.dir")
        one_machine = spark.sparkContext.master.startswith("local")
        if not one_machine and (base.startswith("file:") or ":" not in base):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{base.rstrip('/')}/_cohortline/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession) -> str:
    """A new folder for tables of this application."""
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write the rows to the shared folder and go on from the written table.

    What is planned on top neither repeats the work so far nor depends on executors that hold it,
    and reads only the columns it needs. ``drop_cut`` removes the table when nothing reads it any more.
    """
    spark = df.sparkSession
    path = scratch_path(spark)
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.cut_path = path
    return table


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def drop_cut(*tables: DataFrame) -> None:
    """Remove tables written by ``cut_lineage``."""
    for table in tables:
        _delete(table.sparkSession, table.cut_path)


def drop_all_cuts(spark: SparkSession) -> None:
    """Remove every table this application has written; its results must have been read before."""
    _delete(spark, shared_folder(spark))
