"""What the text operators share.

Every operator reads only the columns it names and gives them internal names first, so further columns of the input,
whatever they are called, never clash with its own. Null texts count as empty. Rows that repeat a doc_id stay apart:
where a result is joined back, the key is the doc_id together with a hash of the text.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rivergraph.functions.scratch import clear_scratch, shared_dir, stored

__all__ = ["ASCII_SPACE", "LOWER", "UPPER", "ascii_lower", "clear_scratch", "keyed", "lean", "shared_dir", "small_batches", "stored", "table", "text_key", "worker_cache"]

#: The white space that the contracts name: [\x20\x09-\x0D].
ASCII_SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


#: Characters that lower() might change, A-Z aside: capitals, and what newer tables than Java's may know as such.
_CAPITALS = r"[\p{IsUppercase}\p{Lt}\p{Cn}\x{10000}-\x{10FFFF}&&[^A-Z]]"


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, all else as it is. lower() does the same where there are no other capitals, many times faster
    than a translation character by character."""
    plain = (F.octet_length(text) == F.char_length(text)) | ~text.rlike(_CAPITALS)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark, most: int = 8 << 20) -> None:
    """From now on a batch that goes to Python holds about `most` bytes, however long its texts are. The setting of the
    session is only ever lowered."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    held = spark.conf.get(name)
    if not held.rstrip("b").isdigit() or int(held.rstrip("b")) > most:
        spark.conf.set(name, str(most))


_caches: dict[str, dict] = {}


def worker_cache(owner: str) -> dict:
    """A dictionary that outlives a task: the owner's tasks in one worker process share it. lean() empties it when another
    operator's task begins there."""
    return _caches.setdefault(owner, {})


def leave_caches(owner: str | None) -> None:
    for name, cache in _caches.items():
        if name != owner:
            cache.clear()


def give_back() -> None:
    """Return to the system what this process has freed; Arrow's and C's allocators would keep it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
    if trim:
        trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], owner: str | None = None):
    """run, for mapInArrow. Spark uses a worker process again for whatever comes next, so what other operators have left in
    it goes before the task, and what the task has freed goes back to the system after it."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leave_caches(owner)
        give_back()
        try:
            yield from run(batches)
        finally:
            give_back()

    return task


def text_key(text: Column | str) -> Column:
    """64-bit hash of the text; a null text hashes as an empty one. Tells apart rows that share a doc_id."""
    return F.xxhash64(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")))


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text (null: empty) and tkey only."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("tkey"))
