"""Token counts as rollups that are maintained by signed changes.

A change inserts a document's count, deletes it, or revises it (the old count leaves, the new one enters, under another
source, language or tokenizer version if need be). A batch of changes is summed to one row of deltas for each key and
committed as one folder named by the batch; totals are the sums over committed batches. A batch that is committed again,
after a lost driver or a repeated message, changes nothing. Sums are additive, so the order of batches does not matter.

Defined cases: null sources, languages and versions are keys of their own; null counts are zero; null texts have no tokens;
repeated rows count each; an empty batch commits and adds nothing; columns besides the named ones are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortline.llm.byte_tokens import coder
from cohortline.llm.common import appended, arrow_schema, released, sliced

KEYS = ("source", "lang", "tokenizer")
SUMS = ("n_docs", "n_tokens")


def bpe_counts(docs: DataFrame, path: str, **counts: str) -> DataFrame:
    """The rows with the number of byte-level BPE tokens of whole texts, ``name=column`` each; 0 for a null."""
    schema = appended(docs.schema, *[T.StructField(name, T.LongType(), False) for name in counts])
    arrow, first = arrow_schema(schema), next(iter(counts.values()))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = coder(path)
        for batch in sliced(batches, first):
            found = {name: pa.array([len(x) // 4 for x in encoder.encode(batch.column(text).to_pylist())], pa.int64()) for name, text in counts.items()}
            yield pa.RecordBatch.from_arrays([found[f.name] if f.name in found else batch.column(f.name).cast(f.type) for f in arrow], schema=arrow)

    return docs.mapInArrow(released(run), schema)


def word_counts(text: str = "text") -> Column:
    """Runs without space, tab, newline, vertical tab, form feed or return."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def signed(rows: DataFrame, sign: int, tokenizer: str, n_tokens: str) -> DataFrame:
    """Changes (source, lang, tokenizer, n_docs, n_tokens) that add or take away the given counts."""
    return rows.select(
        "source", "lang", F.lit(tokenizer).alias("tokenizer"), F.lit(sign).cast("long").alias("n_docs"),
        (F.lit(sign) * F.coalesce(F.col(n_tokens), F.lit(0))).cast("long").alias("n_tokens"),
    )


def inserted(rows: DataFrame, tokenizer: str, n_tokens: str) -> DataFrame:
    return signed(rows, 1, tokenizer, n_tokens)


def deleted(rows: DataFrame, tokenizer: str, n_tokens: str) -> DataFrame:
    return signed(rows, -1, tokenizer, n_tokens)


def revised(rows: DataFrame, tokenizer: str, old: str, new: str) -> DataFrame:
    return deleted(rows, tokenizer, old).union(inserted(rows, tokenizer, new))


class Rollup:
    """Totals by source, language and tokenizer version in a folder that all executors share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.path = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def _batch(self, name: str) -> str:
        if not re.fullmatch(r"[\w.-]+", name):
            raise ValueError(f"batch names are letters, digits, '.', '_' and '-': {name!r}")
        return f"{self.folder}/batch={name}"

    def committed(self, name: str) -> bool:
        """The success mark is written last, after all rows of the batch."""
        return self.fs.exists(self.path(f"{self._batch(name)}/_SUCCESS"))

    def commit(self, name: str, *changes: DataFrame) -> bool:
        """Add a batch of changes; false if the batch is there already. What a broken attempt left is overwritten."""
        if self.committed(name):
            return False
        every = reduce(DataFrame.union, [c.select(*KEYS, *SUMS) for c in changes])
        every.groupBy(*KEYS).agg(*[F.sum(c).alias(c) for c in SUMS]).write.mode("overwrite").parquet(self._batch(name))
        return True

    def batches(self) -> list[str]:
        if not self.fs.exists(self.path(self.folder)):
            return []
        names = [s.getPath().getName() for s in self.fs.listStatus(self.path(self.folder))]
        return sorted(n[6:] for n in names if n.startswith("batch=") and self.committed(n[6:]))

    def totals(self) -> DataFrame:
        """One row for each key that still has documents or tokens."""
        kind = T.StructType([T.StructField(k, T.StringType()) for k in KEYS] + [T.StructField(c, T.LongType()) for c in SUMS])
        names = self.batches()
        rows = self.spark.read.schema(kind).parquet(*[self._batch(n) for n in names]) if names else self.spark.createDataFrame([], kind)
        sums = rows.groupBy(*KEYS).agg(*[F.sum(c).alias(c) for c in SUMS])
        return sums.where((F.col("n_docs") != 0) | (F.col("n_tokens") != 0))
