"""Token ids as binary files of patched frame-of-reference blocks.

A document's ids, with the end id appended, are laid out in ascending doc_id order and cut into blocks of 1024. A block
stores its minimum, the differences packed at the width that holds a percentile of them, and, for the rest, an exception
list of positions and high bits. A file is

    b"RGTOK001" | blocks | index | footer
    block   minimum u32, count u16, width u8, exceptions (up to 1024) u16, packed words u64[], positions u16[], high bits u32[]
    index   u64 start of each block, then doc_id i64[] (null: -2**63) and ids per document u64[], zlib-compressed
    footer  index start u64, blocks u32, documents u32, ids u64, b"RGTOKEND"

Documents are range-partitioned by doc_id; a task streams its partition into one file, block by block, in the folder that
executors share. Every attempt of a task writes a file under a name of its own, and only the manifest that successful
tasks return says which files count, so a lost executor or a second attempt leaves nothing that is read. The sums of ids
before each file come from that manifest (one row a file).

Text is encoded by the tokenizer's model piece by piece: its normalizer (NFC, lower case) and its pre-tokenizer's pattern
are applied to the whole text, and a piece's ids come from a bounded cache or from the model. Texts of rarer characters,
for which Python's tables might differ from the library's, go through the library whole.

Defined cases: a null or empty text has the end id alone; null doc_ids come first, rows that repeat a doc_id are ordered
by text; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import json
import re
import struct
import time
import unicodedata
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import lean, shared_dir, small_batches, stored, table, worker_cache

BLOCK = 1024
PERCENTILE = 0.95
END_ID = 2
#: Pieces whose ids a worker holds; past it, the cache starts anew.
CACHE = 700_000
TOKENIZER = "word_bpe_49k.json"
_HEAD, _FOOT, _BLOCK = b"RGTOK001", b"RGTOKEND", struct.Struct("<IHBH")
_NO_ID = -(1 << 63)


# ---- blocks


def pack(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of 1024 values below 2**width as rows of 16 * width 64-bit words; all rows at once, one of 64 lanes a time."""
    lanes = values.astype(np.uint64).reshape(len(values), -1, 64)
    out = np.zeros((*lanes.shape[:2], width), np.uint64)
    for i in range(64 if width else 0):
        word, off = divmod(i * width, 64)
        out[:, :, word] |= lanes[:, :, i] << np.uint64(off)
        if off + width > 64:
            out[:, :, word + 1] |= lanes[:, :, i] >> np.uint64(64 - off)
    return out.reshape(len(values), -1)


def unpack(words: np.ndarray, width: int) -> np.ndarray:
    """The inverse of pack."""
    groups = words.reshape(len(words), -1, width) if width else None
    out = np.zeros((len(words), BLOCK // 64, 64), np.uint64)
    mask = np.uint64((1 << width) - 1)
    for i in range(64 if width else 0):
        word, off = divmod(i * width, 64)
        lane = groups[:, :, word] >> np.uint64(off)
        if off + width > 64:
            lane = lane | (groups[:, :, word + 1] << np.uint64(64 - off))
        out[:, :, i] = lane & mask
    return out.reshape(len(words), BLOCK)


def encode_blocks(ids: np.ndarray) -> list[bytes]:
    """ids (unsigned 32-bit) as blocks of 1024; the last may count fewer."""
    if not len(ids):
        return []
    short = -len(ids) % BLOCK
    rows = np.concatenate([ids, np.repeat(ids[-1:], short)]).reshape(-1, BLOCK).astype(np.uint32)
    low = rows.min(axis=1)
    rest = rows - low[:, None]
    at = min(BLOCK - 1, int(np.ceil(PERCENTILE * BLOCK)) - 1)
    widths = np.array([int(x).bit_length() for x in np.partition(rest, at, axis=1)[:, at]])
    blocks: list[bytes] = [b""] * len(rows)
    for width in np.unique(widths).tolist():
        which = np.flatnonzero(widths == width)
        part = rest[which]
        packed = pack(part & np.uint32((1 << width) - 1), width)
        high = part.astype(np.uint64) >> np.uint64(width)
        for k, b in enumerate(which.tolist()):
            pos = np.flatnonzero(high[k])
            count = BLOCK - short if b == len(rows) - 1 else BLOCK
            head = _BLOCK.pack(int(low[b]), count, width, len(pos))
            blocks[b] = head + packed[k].tobytes() + pos.astype("<u2").tobytes() + high[k][pos].astype("<u4").tobytes()
    return blocks


def decode_blocks(data: bytes, starts: list[int]) -> np.ndarray:
    """The ids of the blocks that begin at starts."""
    heads = [_BLOCK.unpack_from(data, s) for s in starts]
    out = np.zeros((len(starts), BLOCK), np.uint32)
    for width in {h[2] for h in heads}:
        which = [k for k, h in enumerate(heads) if h[2] == width]
        n = BLOCK // 64 * width
        words = np.stack([np.frombuffer(data, "<u8", n, starts[k] + _BLOCK.size) for k in which]) if n else np.zeros((len(which), 0), np.uint64)
        out[which] = unpack(words, width).astype(np.uint32)
    for k, (low, _, width, odd) in enumerate(heads):
        if odd:
            at = starts[k] + _BLOCK.size + BLOCK // 64 * width * 8
            pos = np.frombuffer(data, "<u2", odd, at)
            out[k, pos] |= (np.frombuffer(data, "<u4", odd, at + 2 * odd).astype(np.uint64) << np.uint64(width)).astype(np.uint32)
        out[k] += np.uint32(low)
    return np.concatenate([out[k, : h[1]] for k, h in enumerate(heads)]) if heads else np.zeros(0, np.uint32)


# ---- files


class Writer:
    """Writes one file as documents arrive; holds at most one block's rest and `hold` blocks' ids."""

    def __init__(self, sink, hold: int = 256):
        self.sink, self.hold, self.at = sink, hold * BLOCK, len(_HEAD)
        self.starts: list[int] = []
        self.doc_ids: list[int] = []
        self.counts: list[int] = []
        self.waiting: list[np.ndarray] = []
        self.n_waiting = self.n_ids = 0
        sink.write(_HEAD)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.doc_ids.append(_NO_ID if doc_id is None else doc_id)
        self.counts.append(len(ids))
        self.waiting.append(ids)
        self.n_waiting += len(ids)
        self.n_ids += len(ids)
        if self.n_waiting >= self.hold:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.concatenate(self.waiting) if self.waiting else np.zeros(0, np.uint32)
        n = len(ids) if last else len(ids) // BLOCK * BLOCK
        for i in range(0, n, self.hold):
            for b in encode_blocks(ids[i : min(n, i + self.hold)]):
                self.starts.append(self.at)
                self.sink.write(b)
                self.at += len(b)
        self.waiting, self.n_waiting = [ids[n:]], len(ids) - n

    def close(self) -> None:
        self._flush(True)
        index = zlib.compress(np.array(self.starts, "<u8").tobytes() + np.array(self.doc_ids, "<i8").tobytes() + np.array(self.counts, "<u8").tobytes(), 1)
        self.sink.write(index)
        self.sink.write(struct.pack("<QIIQ", self.at, len(self.starts), len(self.doc_ids), self.n_ids) + _FOOT)
        self.sink.close()


def read_documents(source, blocks_at_once: int = 256) -> Iterator[tuple[int | None, int, np.ndarray]]:
    """doc_id, ids before it in this file, its ids; from an open file that can seek."""
    size = source.size()
    source.seek(size - 32)
    index, n_blocks, n_docs, _ = struct.unpack("<QIIQ", (foot := source.read(32))[:24])
    if foot[24:] != _FOOT:
        raise ValueError("not a token file, or cut short")
    source.seek(index)
    raw = zlib.decompress(source.read(size - 32 - index))
    starts = [*np.frombuffer(raw, "<u8", n_blocks).tolist(), index]
    doc_ids = np.frombuffer(raw, "<i8", n_docs, 8 * n_blocks).tolist()
    counts = np.frombuffer(raw, "<u8", n_docs, 8 * (n_blocks + n_docs)).tolist()
    held, block, before = np.zeros(0, np.uint32), 0, 0
    for doc_id, count in zip(doc_ids, counts, strict=True):
        if len(held) < count:
            parts, have = [held], len(held)
            while have < count:
                upto = min(n_blocks, block + blocks_at_once)
                source.seek(starts[block])
                data = source.read(starts[upto] - starts[block])
                parts.append(decode_blocks(data, [s - starts[block] for s in starts[block:upto]]))
                have += len(parts[-1])
                block = upto
            held = np.concatenate(parts)
        yield (None if doc_id == _NO_ID else doc_id), before, held[:count]
        held, before = held[count:], before + count


# ---- tokenizing


#: Texts of other characters than these, or with a special token's mark, are encoded whole, without the cache.
_PLAIN = re.compile("[^\t-\r\x20-\x7e\xc0-\u017f\u2013\u2014\u2018-\u201e\u2026]")
#: What the tokenizer's own pre-tokenizer pattern finds in such texts.
#: The rules of the tokenizer file for which _PIECE and Pieces.encode stand.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
PRE_TOKENIZERS = (
    {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "use_regex": False},
)
_PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+")


def byte_letters() -> dict[int, int]:
    """The letters that stand for bytes in byte-level vocabularies: printable Latin-1 for itself, others from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    return {b: 256 + k for k, b in enumerate(x for x in range(256) if x not in set(plain))}


def has_known_rules(config: str) -> bool:
    """Whether a tokenizer parts texts as _PIECE does: the normalizer and pre-tokenizer are those written here, and all added
    tokens begin with a mark that sends texts to the library. Any other tokenizer encodes whole texts."""
    rules = json.loads(config)
    parts = rules["pre_tokenizer"] or {}
    parts = parts.get("pretokenizers", [parts])
    same = [{k: p.get(k) for k in want} for p, want in zip(parts, PRE_TOKENIZERS, strict=False)] == list(PRE_TOKENIZERS) and len(parts) == len(PRE_TOKENIZERS)
    return same and rules["normalizer"] == NORMALIZER and all(t["content"].startswith("<|") for t in rules["added_tokens"])


class Pieces:
    """Encodes texts piece by piece; holds the ids, as bytes, of up to `cache` pieces."""

    def __init__(self, path: str, cache: int = CACHE):
        from tokenizers import Tokenizer

        self.tokenizer, self.cache, self.known = Tokenizer.from_file(path), cache, {}
        self.model, self.letters = self.tokenizer.model, byte_letters()
        self.plain = has_known_rules(self.tokenizer.to_str())

    def _learn(self, piece: str) -> bytes:
        word = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.letters)
        ids = self.known[piece] = array("I", [t.id for t in self.model.tokenize(word)]).tobytes()
        return ids

    def encode(self, text: str) -> bytes:
        """The ids of a text, 32-bit in this machine's byte order."""
        if not self.plain or _PLAIN.search(text) or "<|" in text:
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        pieces = _PIECE.findall((text if text.isascii() else unicodedata.normalize("NFC", text)).lower())
        found = list(map(self.known.get, pieces))
        if None in found:
            if len(self.known) > self.cache:
                self.known.clear()
            found = [x if x is not None else self.known.get(p) or self._learn(p) for p, x in zip(pieces, found, strict=True)]
        return b"".join(found)


_OWNER = "tokens"
_pieces: dict[str, Pieces] = worker_cache(_OWNER)


def pieces_of(path: str) -> Pieces:
    """One cache for all tasks that write files in a worker process; it goes when the files are read back."""
    if path not in _pieces:
        _pieces[path] = Pieces(path)
    return _pieces[path]


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _opened(uri: str):
    return pafs.FileSystem.from_uri(uri)


_MANIFEST = "file string, first_id long, last_id long, n_docs long, n_ids long, n_bytes long, part int"


def write_tokens(docs: DataFrame, folder: str, *, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Write token files under folder (a URI that executors share); returns the manifest: a row a file, in doc_id order,
    with `before`, the ids in all files before it."""
    path = tokenizer or tokenizer_path()
    end = np.array([end_id], np.uint32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        writer = None
        for b in batches:
            ids, texts = b.column("doc_id").to_pylist(), b.column("text").to_pylist()
            if not ids:
                continue
            if writer is None:
                fs, base = _opened(folder)
                fs.create_dir(base, recursive=True)
                context = TaskContext.get()
                name = f"tokens-{context.partitionId():05d}-{context.taskAttemptId()}-{uuid.uuid4().hex}.rgtok"
                writer, first, pieces = Writer(fs.open_output_stream(f"{base}/{name}", buffer_size=1 << 20)), ids[0], pieces_of(path)
            for doc_id, text in zip(ids, texts, strict=True):
                writer.add(doc_id, np.concatenate([np.frombuffer(pieces.encode(text), np.uint32), end]))
            last = ids[-1]
        if writer is not None:
            writer.close()
            size = fs.get_file_info(f"{base}/{name}").size
            row = {"file": f"{folder}/{name}", "first_id": first, "last_id": last, "n_docs": len(writer.doc_ids), "n_ids": writer.n_ids,
                "n_bytes": size, "part": context.partitionId()}
            yield pa.RecordBatch.from_pylist([row],
                schema=pa.schema([(k, {"string": pa.string(), "long": pa.int64(), "int": pa.int32()}[t]) for k, t in (x.split() for x in _MANIFEST.split(", "))]))

    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    # the beginning of the text parts rows that repeat a doc_id, or lack one, over as many files as they need
    small_batches(docs.sparkSession)
    ordered = base.repartitionByRange(F.col("doc_id"), F.substring("text", 1, 64)).sortWithinPartitions("doc_id", "text")
    manifest = stored(ordered.mapInArrow(lean(run, _OWNER), _MANIFEST))
    before = F.sum("n_ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    return manifest.withColumn("before", F.coalesce(before, F.lit(0)))


def read_tokens(manifest: DataFrame, ids: bool = False) -> DataFrame:
    """A row per document: doc_id, start (ids of all documents before it), n_tokens, ids_crc32; with `ids`, the ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, before in zip(b.column("file").to_pylist(), b.column("before").to_pylist(), strict=True):
                fs, path = _opened(file)
                with fs.open_input_file(path) as source:
                    rows: list[tuple] = []
                    weight = 0
                    for doc_id, at, found in read_documents(source):
                        rows.append((doc_id, before + at, len(found), zlib.crc32(found.astype("<u4").tobytes()), *([found.astype(np.int64)] if ids else [])))
                        weight += 8 * len(found) * ids + 64
                        if weight > 16 << 20:
                            yield _batch(rows)
                            rows, weight = [], 0
                    if rows:
                        yield _batch(rows)

    # as many partitions as files: without a number, so few small rows would be put into one task
    files = max(1, manifest.count())
    return manifest.select("file", "before").repartition(files, "file").mapInArrow(lean(run), "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * ids)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 4 + [pa.list_(pa.int64())]
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=False)],
        names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(rows[0])])


def encode_and_read(docs: DataFrame) -> DataFrame:
    """Write docs to files in the shared folder and read them back."""
    folder = f"{shared_dir(docs.sparkSession)}/tokens-{time.strftime('%Y%m%d%H%M%S')}-{uuid.uuid4().hex}"
    return read_tokens(write_tokens(docs, folder if "://" in folder else "file://" + folder))


def op8_tokens(spark, sf_dir: str) -> DataFrame:
    return encode_and_read(table(spark, sf_dir, "documents"))
