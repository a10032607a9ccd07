"""Line dedup: hashes of lines, range-partitioned, with a secondary sort by document and position.

A line's key is the line without ASCII white space at both ends, A-Z lower-cased. Keys of at least `least_chars` code
points that occur in two documents or more keep their lines only in the smallest doc_id that holds them.

Only 128-bit hashes move. They are range-partitioned by (hash, document, position), so the rows of one hot line spread
over as many partitions as they need, and sorted inside each. A pass streams the sorted rows: it holds one row, compares,
and drops what is not the first document of its run. A run that a partition boundary cuts is settled by its two ends: each
partition reports the first document of its first and last run (two rows a partition, broadcast), and the rows of a
partition's first run wait for the smallest of those.

What comes back is a bitmap of kept lines per document, zlib-compressed, no text.

Defined cases: a null or empty text is one empty line; rows that repeat a doc_id are one document to the rule, and each
row gets the bitmap of its own text; a null doc_id counts as the largest id; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ASCII_SPACE, LOWER, UPPER, ascii_lower, keyed, small_batches, stored, table

LEAST_CHARS = 10
_LAST = (1 << 63) - 1


def line_rows(docs: DataFrame, least_chars: int) -> DataFrame:
    """h1, h2, doc (order of documents), tkey, n_lines, at (positions of the line in the document)."""
    # what holds for a document is made in a projection of its own: beside the generator it would be made once a line
    n_lines = (F.char_length("text") - F.char_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).cast("int")
    whole = docs.select(F.coalesce("doc_id", F.lit(_LAST)).alias("doc"), "tkey", n_lines.alias("n_lines"), "text")
    one = whole.select("doc", "tkey", "n_lines", F.posexplode(F.split("text", "\n", -1)).alias("at", "line"))
    one = one.withColumn("line", F.btrim("line", F.lit(ASCII_SPACE))).where(F.char_length("line") >= least_chars).withColumn("line", ascii_lower(F.col("line")))
    one = one.withColumn("h1", F.xxhash64("line")).withColumn("h2", F.xxhash64(F.lit("line"), "line"))
    return one.select("h1", "h2", "doc", "tkey", "n_lines", "at")


_OUT = "kind int, h1 long, h2 long, first long, doc long, tkey long, n_lines int, at int"


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Kind 0: a dropped line. 1: a line of the partition's first run, kept unless the run began before. 2: the first
    document of the partition's first or last run."""
    names = ("h1", "h2", "doc", "tkey", "n_lines", "at")
    run = None  # hash of the run that the last row belonged to
    first = 0  # its first document
    opening = True  # still in the partition's first run

    def out(kind: int, cols: dict, firsts: np.ndarray) -> pa.RecordBatch:
        n = len(firsts)
        data = [np.full(n, kind, np.int32), cols["h1"], cols["h2"], firsts, cols["doc"], cols["tkey"], cols["n_lines"].astype(np.int32), cols["at"].astype(np.int32)]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in data], names=["kind", "h1", "h2", "first", "doc", "tkey", "n_lines", "at"])

    def edge(h: tuple, doc: int) -> pa.RecordBatch:
        zero = np.zeros(1, np.int64)
        return out(2, {"h1": np.array([h[0]]), "h2": np.array([h[1]]), "doc": zero, "tkey": zero, "n_lines": zero, "at": zero}, np.array([doc]))

    for b in batches:
        if not b.num_rows:
            continue
        c = {n: b.column(n).to_numpy(zero_copy_only=False) for n in names}
        new = np.empty(b.num_rows, bool)
        new[0] = run is None or (int(c["h1"][0]), int(c["h2"][0])) != run
        new[1:] = (c["h1"][1:] != c["h1"][:-1]) | (c["h2"][1:] != c["h2"][:-1])
        starts = np.flatnonzero(new)
        firsts = np.full(b.num_rows, first, np.int64)
        which = np.cumsum(new)
        if len(starts):
            firsts[which > 0] = c["doc"][starts][which[which > 0] - 1]
        if run is None:
            yield edge((int(c["h1"][0]), int(c["h2"][0])), int(c["doc"][0]))
        drop = c["doc"] != firsts
        if drop.any():
            yield out(0, {k: v[drop] for k, v in c.items()}, firsts[drop])
        if opening:
            ahead = which == 1 if run is None else which == 0
            if (wait := ahead & ~drop).any():
                yield out(1, {k: v[wait] for k, v in c.items()}, firsts[wait])
            opening = not (which > (1 if run is None else 0)).any()
        run, first = (int(c["h1"][-1]), int(c["h2"][-1])), int(firsts[-1])
    if run is not None:
        yield edge(run, first)


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        maps = []
        for n, gone in zip(b.column("n_lines").to_pylist(), b.column("gone").to_pylist(), strict=True):
            keep = np.ones(n, np.uint8)
            keep[gone] = 0
            maps.append(zlib.compress(np.packbits(keep, bitorder="little").tobytes(), 1))
        yield pa.RecordBatch.from_arrays([b.column("doc"), b.column("tkey"), pa.array(maps, pa.binary())], names=["doc", "tkey", "keep"])


def line_keep_bitmaps(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least_chars: int = LEAST_CHARS) -> DataFrame:
    """doc (doc_id; null as 2**63 - 1), tkey, keep: one row per document that loses lines. Bit i of keep (little end
    first, after zlib) is line i."""
    small_batches(docs.sparkSession)
    # the hashes are stored first: range partitioning reads its input twice, and the second time they need no text
    rows = stored(line_rows(keyed(docs, id_col, text_col), least_chars)).repartitionByRange("h1", "h2", "doc", "at")
    told = stored(rows.sortWithinPartitions("h1", "h2", "doc", "at").mapInArrow(_stream, _OUT))
    edges = told.where("kind = 2").groupBy("h1", "h2").agg(F.min("first").alias("least"))
    late = told.where("kind = 1").join(F.broadcast(edges), ["h1", "h2"]).where("least < doc")
    cols = ("doc", "tkey", "n_lines", "at")
    gone = told.where("kind = 0").select(*cols).unionByName(late.select(*cols)).groupBy("doc", "tkey").agg(F.first("n_lines").alias("n_lines"), F.collect_set("at").alias("gone"))
    return gone.mapInArrow(_bitmaps, "doc long, tkey long, keep binary")


def with_bitmaps(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text, keep (null: all lines) for each row of docs."""
    base = keyed(docs, id_col, text_col)
    maps = bitmaps.select(F.col("doc").alias("_doc"), F.col("tkey").alias("_tkey"), "keep")
    return base.join(maps, (F.coalesce("doc_id", F.lit(_LAST)) == F.col("_doc")) & (F.col("tkey") == F.col("_tkey")), "left").select("doc_id", "text", "keep")


def kept_lines(text: str, keep: bytes | None) -> tuple[list[str], int]:
    """The lines that stay, and how many there were."""
    lines = text.split("\n")
    if keep is None:
        return lines, len(lines)
    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), count=len(lines), bitorder="little")
    return [x for x, k in zip(lines, bits.tolist(), strict=True) if k], len(lines)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        n, gone, sha = [], [], []
        for text, keep in zip(b.column("text").to_pylist(), b.column("keep").to_pylist(), strict=True):
            lines, count = kept_lines(text, keep)
            n.append(count)
            gone.append(count - len(lines))
            sha.append(hashlib.sha256("\n".join(lines).encode()).hexdigest())
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha)],
            names=["doc_id", "n_lines", "n_dropped", "kept_sha256"])


def op4_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return with_bitmaps(docs, line_keep_bitmaps(docs)).mapInArrow(_digest, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")


ORACLE = f"""
with d as (select row_number() over () rid, doc_id, string_split(coalesce(text, ''), chr(10)) ls from documents),
e as (select rid, doc_id, unnest(range(len(ls))) i, unnest(ls) l from d),
k as (select *, translate(trim(l, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))), '{UPPER}', '{LOWER}') k from e),
m as (select k, min(coalesce(doc_id, {_LAST})) least, count(distinct coalesce(doc_id, {_LAST})) n from k where length(k) >= {LEAST_CHARS} group by k),
x as (select k.*, coalesce(n, 1) >= 2 and coalesce(doc_id, {_LAST}) <> least gone from k left join m using (k))
select any_value(doc_id) doc_id, count(*) n_lines, count(*) filter (coalesce(gone, false)) n_dropped,
  sha256(coalesce(string_agg(l, chr(10) order by i) filter (not coalesce(gone, false)), '')) kept_sha256
from x group by rid
"""
