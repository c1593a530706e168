"""Helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text handled at once inside a task; what is made of them on the way takes up to a hundred times as much.
SLICE_BYTES = 1 << 20


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def sliced(batches: Iterable[pa.RecordBatch], text: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``limit`` bytes of text, one row at least.

    Long documents then make small batches, so that a worker's memory follows one slice and not the row count.
    """
    for batch in batches:
        if batch.num_rows == 0:
            continue
        if batch.nbytes <= limit:
            yield batch
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist()
        start, size = 0, 0
        for row, length in enumerate(lengths):
            if size and size + length > limit:
                yield batch.slice(start, row - start)
                start, size = row, 0
            size += length
        yield batch.slice(start)


def arrow_schema(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def free_name(name: str, taken: Iterable[str]) -> str:
    """``name``, or with underscores until no column has it (names are compared without case)."""
    used = {x.lower() for x in taken}
    while name.lower() in used:
        name += "_"
    return name


def appended(schema: T.StructType, *fields: T.StructField) -> T.StructType:
    """The schema without columns that would clash with ``fields``, followed by these."""
    new = {f.name.lower() for f in fields}
    return T.StructType([f for f in schema.fields if f.name.lower() not in new] + list(fields))


def key_as_text(column) -> F.Column:
    return F.coalesce(column.cast("string"), F.lit(""))


def released(run):
    """``run`` over batches, after which the worker gives freed memory back to the system.

    Workers wait for further tasks beside an executor's JVM, which may need the memory meanwhile.
    """
    def whole(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
                trim(0)

    return whole


class WordCache:
    """Values by word in two generations of bounded size in bytes.

    What has not been asked for during a whole generation is forgotten, and long words are not kept at all, so memory follows
    neither the vocabulary nor the texts. Workers outlive tasks: a task clears its cache when it ends.
    """

    #: Characters of the longest word that is kept.
    LONGEST = 64
    #: What an entry takes besides its word and value.
    ENTRY = 200

    def __init__(self, limit: int = 24 << 20):
        self.limit = limit
        self.clear()

    def clear(self) -> None:
        self.new, self.old, self.size = {}, {}, 0

    def values(self, words: list, make) -> list:
        """One value for each word; ``make`` gets the list of distinct unknown words and returns their values."""
        found = list(map(self.new.get, words))
        if None in found:
            late = {w for w, v in zip(words, found, strict=True) if v is None}
            fresh = {w: v for w in late if (v := self.old.get(w)) is not None}
            unknown = [w for w in late if w not in fresh]
            fresh.update(zip(unknown, make(unknown), strict=True))
            found = [fresh[w] if v is None else v for w, v in zip(words, found, strict=True)]
            self._keep(fresh)
        return found

    def _keep(self, fresh: dict) -> None:
        for word, value in fresh.items():
            length = sum(len(x) for x in word if isinstance(x, str)) if isinstance(word, tuple) else len(word)
            if length <= self.LONGEST:
                self.new[word] = value
                self.size += length + len(value) + self.ENTRY
                if self.size > self.limit:
                    self.old, self.new, self.size = self.new, {}, 0
