"""Substring dedup by repeated-phrase automata.

A window is `n` consecutive words. Every window has an anchor: the phrase of `k` words in it with the smallest hash. Equal
windows have equal anchors, so only windows whose anchor recurs can recur.

1. Each document is read once for its anchors, about one for every 14 words. Documents of equal words are one text from
   then on: if it has a window, all of it recurs. Anchors are counted over texts (combined before the exchange).
2. Passages are confirmed. In texts with recurring anchors, windows with such an anchor are counted by 128-bit hashes, again
   combined before the exchange. The count carries one place of each window back: where the window is alone, so that
   its text leaves it alone; where it recurs, so that the phrase at its anchor is read there, once for all its places.
3. The phrases of confirmed passages are routed to the texts that have their anchors. A task compiles the phrases that a
   shard of texts may hold into one Aho-Corasick automaton and streams those texts through it, which locates every
   occurrence: the task knows no place of a phrase but those that the automaton reports. Words under windows that are
   anchored at a report, and were not alone, go. Automata are bounded by the shard's text, whatever the corpus holds.

No step gathers the occurrences of one passage, so a passage in a third of all documents costs what its text costs.

Defined cases: a null or empty text has no words; windows that repeat inside a document, or across rows that repeat a
doc_id, recur; each row gives a row, and fully repeated rows agree; texts of fewer than `n` words lose nothing; a null
doc_id is kept; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keyed, small_batches, stored, table
from .quality import words_of

N, K = 35, 8
#: Characters of text whose phrases share an automaton.
SHARD_CHARS = 4_000_000
#: The hashes of texts that occur more than once are broadcast up to so many (about 100 bytes each).
BROADCAST_KEYS = 500_000
_P1, _P2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03)


def _mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finisher."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    def __init__(self, most: int = 400_000):
        self.most = most

    def __missing__(self, word: str) -> int:
        if len(self) >= self.most:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h

    def of(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def rolling(h: np.ndarray, n: int, p: np.uint64) -> np.ndarray:
    """Polynomial hashes (modulo 2**64, then mixed) of all windows of n; in n's logarithm of steps."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    done, power, block, block_len, block_power = None, np.uint64(1), h, 1, p
    at = 0
    while n:  # n in binary: blocks of 1, 2, 4, ... words, appended where the bit is set
        if n & 1:
            part = block[at:]
            done = part if done is None else done[: len(part)] * block_power + part
            at += block_len
            power = power * block_power
        n >>= 1
        if n:
            block = block[:-block_len] * block_power + block[block_len:]
            block_len, block_power = block_len * 2, block_power * block_power
    return _mix(done)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    span = 1
    while span * 2 <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return np.minimum(x[: len(x) - (width - span)], x[width - span :]) if width > span else x


def anchors(h: np.ndarray, n: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all phrases of k words, and of each window's anchor."""
    with np.errstate(over="ignore"):
        phrase = rolling(h, k, _P1)
    return phrase, sliding_min(phrase, n - k + 1) if len(h) >= n else np.zeros(0, np.uint64)


def _anchor_rows(n: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in batches:
            counts, sha, hs, twice = [], [], [], []
            for text in b.column("text").to_pylist():
                words = words_of(text)
                phrase, low = anchors(hashes.of(words), n, k)
                used, times = np.unique(phrase[np.isin(phrase, low)], return_counts=True)
                counts.append(len(words))
                sha.append(_sha(words))
                hs.append(used.view(np.int64))
                twice.append(times > 1)
            kinds = (pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.bool_()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("tkey"),
                *(pa.array(x, t) for x, t in zip((counts, sha, hs, twice), kinds, strict=True))], names=["doc_id", "tkey", "n_words", "sha", "hs", "twice"])

    return run


def _sha(words: list[str]) -> str:
    return hashlib.sha256(" ".join(words).encode("utf-8", "surrogatepass")).hexdigest()


class Located:
    """Occurrences of phrases, by one automaton."""

    def __init__(self, phrases: set[str], k: int):
        import ahocorasick

        self.automaton, self.k = ahocorasick.Automaton(), k
        for text in phrases:
            self.automaton.add_word(f" {text} ", 0)
        if phrases:
            self.automaton.make_automaton()

    def starts(self, words: list[str]) -> np.ndarray:
        """The words at which phrases begin."""
        if len(words) < self.k or not len(self.automaton):
            return np.zeros(0, np.int64)
        lasts = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)  # the space after each word
        ends = np.fromiter((e for e, _ in self.automaton.iter(f" {' '.join(words)} ")), np.int64)
        return np.searchsorted(lasts, ends) - (self.k - 1)


def _shards(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]) -> Iterator[dict[str, list]]:
    """Columns of as many rows as hold SHARD_CHARS of text."""
    held: dict[str, list] = {n: [] for n in names}
    chars = 0
    for b in batches:
        cols = [b.column(n).to_pylist() for n in names]
        for row in zip(*cols, strict=True):
            for n, v in zip(names, row, strict=True):
                held[n].append(v)
            chars += len(row[names.index("text")])
            if chars >= SHARD_CHARS:
                yield held
                held, chars = {n: [] for n in names}, 0
    if chars or held["text"]:
        yield held


def _candidate_rows(n: int, k: int):
    """row, w1, w2, at of windows whose anchor is among the row's recurring ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        cols: list[list] = [[], [], [], []]
        size = 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in cols], names=["row", "w1", "w2", "at"])

        for b in batches:
            for row, text, hs in zip(*(b.column(c).to_pylist() for c in ("row", "text", "hs")), strict=True):
                h = hashes.of(words_of(text))
                _, low = anchors(h, n, k)
                starts = np.flatnonzero(np.isin(low, np.array(hs, np.int64).view(np.uint64)))
                if not len(starts):
                    continue
                with np.errstate(over="ignore"):
                    w1, w2 = rolling(h, n, _P1)[starts], rolling(_mix(h + _P2), n, _P2)[starts]
                for c, v in zip(cols, (np.full(len(starts), row, np.int64), w1.view(np.int64), w2.view(np.int64), starts.astype(np.int32)), strict=True):
                    c.append(v)
                size += len(starts)
                if size > 200_000:
                    yield out()
                    cols, size = [[], [], [], []], 0
        if size:
            yield out()

    return run


def _phrase_rows(n: int, k: int):
    """h, phrase: the phrases at the anchors of the windows that begin at `starts`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in batches:
            found: dict[int, str] = {}
            for text, starts in zip(b.column("text").to_pylist(), b.column("starts").to_pylist(), strict=True):
                words = words_of(text)
                phrase, low = anchors(hashes.of(words), n, k)
                for i in np.flatnonzero(np.isin(phrase, low[np.array(starts, np.int64)])).tolist():
                    found.setdefault(int(phrase[i].view(np.int64)), " ".join(words[i : i + k]))
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.string())], names=["h", "phrase"])

    return run


def removed_mask(count: int, starts: np.ndarray, alone: list[int], n: int) -> np.ndarray:
    """Words under windows that start at starts and are not alone."""
    good = starts[~np.isin(starts, np.array(alone, np.int64))]
    steps = np.zeros(count + 1, np.int64)
    np.add.at(steps, good, 1)
    np.add.at(steps, good + n, -1)
    return np.cumsum(steps)[:count] > 0


def _cleaned(n: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for held in _shards(batches, ("row", "text", "phrases", "alone")):
            gone, sha, spans = [], [], []
            located = Located({p for own in held["phrases"] for p in own}, k)
            for text, alone in zip(held["text"], held["alone"], strict=True):
                words = words_of(text)
                phrase, low = anchors(hashes.of(words), n, k)
                reported = located.starts(words)
                # a window is anchored at a report if the least phrase in it is one that the automaton found there
                starts = np.flatnonzero(np.isin(low, phrase[reported])) if len(reported) else reported
                mask = removed_mask(len(words), starts, alone or [], n)
                edges = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
                gone.append(int(mask.sum()))
                spans.append([{"from": a, "to": b} for a, b in edges.reshape(-1, 2).tolist()])
                sha.append(_sha([w for w, m in zip(words, mask.tolist(), strict=True) if not m]))
            kinds = {"row": pa.int64(), "gone": pa.int64(), "left": pa.string(), "cut": pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))}
            yield pa.RecordBatch.from_pydict({"row": held["row"], "gone": gone, "left": sha, "cut": spans}, schema=pa.schema(kinds))

    return run


def substring_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", n: int = N, k: int = K) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_removed, kept_sha256 (of the words that stay, joined by a space), spans
    (disjoint [from, to) of the words that go)."""
    small_batches(docs.sparkSession)
    base = keyed(docs, id_col, text_col)
    read = base.mapInArrow(_anchor_rows(n, k), "doc_id long, tkey long, n_words long, sha string, hs array<long>, twice array<boolean>")
    rows = stored(read.withColumn("row", F.monotonically_increasing_id()))
    # what equal texts there are comes from an aggregation; only their keys are joined back
    leads = stored(rows.groupBy("sha").agg(F.count("*").alias("copies"), F.min("row").alias("row")))
    several = leads.where("copies > 1").select(F.col("sha").alias("_sha"), "copies")
    several = F.broadcast(several) if several.count() <= BROADCAST_KEYS else several
    held = rows.join(leads.select("row"), "row", "left_semi").select("row", F.explode(F.arrays_zip("hs", "twice")).alias("x")).select("row",
        F.col("x.hs").alias("h"), F.col("x.twice").alias("twice"))
    recurring = held.groupBy("h").agg(F.count("*").alias("texts"), F.bool_or("twice").alias("twice")).where("texts > 1 or twice").select("h")
    anchored = stored(held.select("row", "h").join(recurring, "h"))
    routed = anchored.groupBy("row").agg(F.collect_list("h").alias("hs"))
    routed = rows.select("row", "doc_id", "tkey").join(routed, "row").join(leads.select("row", "copies"), "row").withColumnsRenamed({"doc_id": "_doc", "tkey": "_tkey"})
    # rows that are the same in id and text led as one; only one of them need be read
    busy = stored(base.join(routed, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("tkey") == F.col("_tkey"))).select("row", "text", "hs", "copies"))
    windows = busy.select("row", "text", "hs").mapInArrow(_candidate_rows(n, k), "row long, w1 long, w2 long, at int")
    counted = stored(windows.groupBy("w1", "w2").agg(F.count("*").alias("n"), F.min(F.struct("row", "at")).alias("p")).select((F.col("n") == 1).alias("alone"), "p.row", "p.at"))
    alone = counted.where("alone").groupBy("row").agg(F.collect_list("at").alias("alone"))
    sources = counted.where("not alone").groupBy("row").agg(F.collect_list("at").alias("starts"))
    phrases = busy.select("row", "text").join(sources, "row").select("text", "starts").mapInArrow(_phrase_rows(n, k), "h long, phrase string").distinct()
    single = busy.where("copies = 1").select("row", "text")
    wanted = anchored.join(phrases, "h").groupBy("row").agg(F.collect_list("phrase").alias("phrases"))
    single = single.join(wanted, "row").join(alone, "row", "left").select("row", "text", "phrases", "alone")
    cleaned = single.mapInArrow(_cleaned(n, k), "row long, gone long, left string, cut array<struct<from: long, to: long>>")
    whole = F.col("copies").isNotNull() & (F.col("n_words") >= n)
    all_words = F.array(F.struct(F.lit(0).cast("long").alias("from"), F.col("n_words").alias("to")))
    none = F.array().cast("array<struct<from: long, to: long>>")
    told = rows.select("row", "doc_id", "n_words", "sha").join(several, F.col("sha") == F.col("_sha"), "left").join(cleaned, "row", "left")
    return told.select(
        "doc_id",
        "n_words",
        F.when(whole, F.col("n_words")).otherwise(F.coalesce("gone", F.lit(0))).alias("n_removed"),
        F.when(whole, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("left", "sha")).alias("kept_sha256"),
        F.when(whole, all_words).otherwise(F.coalesce("cut", none)).alias("spans"),
    )


def op6_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents")).drop("spans")
