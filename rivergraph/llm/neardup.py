"""Near-duplicate detection by Order MinHash, verified by banded alignment.

A document's words (lower-cased runs of letters and digits) give k-mers of five words, each labelled with how often it
occurred before, so repeats count. A sketch takes the `ELL` smallest k-mers under a hash of its own and keeps them in the
order of the text: documents agree on it with a probability near the square of their k-mer similarity, less if reordered.
`SKETCHES` sketches make bands of `ROWS`; documents that share a band are candidates. Texts in the same order at a k-mer
similarity of 0.8 share none of the 16 bands with a probability near 2e-4.

1. Texts with equal words are one node from the start; only one of them goes on.
2. In a band's bucket the node that shares most buckets leads. Every other one is compared with its leader alone, so a
   bucket costs its size. All buckets of one leader are its star; two nodes that share a bucket share a star.
3. A pair is near if the k-mers (with their labels) have a Jaccard similarity of at least 0.8, and an alignment of the
   words within the band that this allows matches at least 0.8 of the longer text.
4. Nodes near their leader are one class. What is left is a node that is not near its leader and may still be near another
   of the star. Whether it may follows from what the comparison with the leader told, without the texts: with u k-mers that
   no other node of the star has, and the set A of the leader's k-mers that it has, two nodes differ in at least
   u + u' + |A xor A'| k-mers, while J >= 0.8 allows a ninth of both sizes. The sets A are bitmaps; nodes meet by steps of
   |A|, and what passes is held against the whole difference (the sets A, and the k-mers that the leader lacks). Only pairs
   of a similarity of 0.8 become rows, to be aligned as in 3. No pair that is near is lost, and nothing is capped.
5. Classes are the connected components of near pairs: classes hook to their least neighbour and pointers double, so a
   chain of n links takes a logarithm of rounds; every step is a join.

The comparisons inside step 4 (not its rows) still grow with the nodes that a leader parts times those near in |A|.

Defined cases: null texts, empty ones and others without words are in a class of their own each; texts of fewer than five
words are one k-mer; rows that repeat a doc_id give a row each, with the class of their own text; null doc_ids get no
class; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import keyed, lean, small_batches, stored, table, text_key

K, SKETCHES, ROWS, ELL, LEAST = 5, 32, 2, 2, 0.8
BANDS = SKETCHES // ROWS
#: Two sets with a Jaccard similarity of LEAST differ in at most this share of the sum of their sizes.
APART = (1 - LEAST) / (1 + LEAST)
#: Nodes of a star meet by steps of this share of the leader's k-mers.
STEPS = 8
#: The keys of texts to be read again are broadcast up to so many (about 32 bytes each); beyond that the join is by shuffle.
BROADCAST_KEYS = 1_000_000
_WORD = re.compile(r"[^\W_]+")
_P = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: A factor and a summand for each sketch's hash.
FACTORS = _mix(np.arange(1, SKETCHES + 1, dtype=np.uint64) * _P) | np.uint64(1)
SUMMANDS = _mix(np.arange(101, SKETCHES + 101, dtype=np.uint64) * _P)


class _Words(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= 200_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


def word_hashes(text: str, words: _Words) -> np.ndarray:
    found = _WORD.findall(text.lower())
    return np.fromiter(map(words.__getitem__, found), np.uint64, len(found))


def labelled_kmers(h: np.ndarray, k: int = K) -> np.ndarray:
    """Hashes of the k-mers in the text's order, each with the number of its earlier occurrences mixed in."""
    if not len(h):
        return h
    k = min(k, len(h))
    with np.errstate(over="ignore"):
        x = np.zeros(len(h) - k + 1, np.uint64)
        for i in range(k):
            x = x * _P + h[i : len(h) - k + 1 + i]
        x = _mix(x)
        order = np.argsort(x, kind="stable")
        s = x[order]
        first = np.concatenate([[True], s[1:] != s[:-1]])
        if first.all():
            return x
        begin = np.maximum.accumulate(np.where(first, np.arange(len(s)), 0))
        label = np.empty(len(s), np.uint64)
        label[order] = np.arange(len(s)) - begin
        return np.where(label > 0, _mix(x + label * _P), x)


def sketch(kmers: np.ndarray, chunk: int = 4096) -> np.ndarray:
    """32 bits for each sketch; k-mers are read in chunks, so long texts take no more memory."""
    n = len(kmers)
    best = np.zeros((SKETCHES, 0), np.uint64)
    where = np.zeros((SKETCHES, 0), np.int64)
    with np.errstate(over="ignore"):
        for a in range(0, n, chunk):
            part = kmers[a : a + chunk]
            x = part[None, :] * FACTORS[:, None] + SUMMANDS[:, None]
            x ^= x >> np.uint64(32)
            for _ in range(min(ELL, len(part))):
                at = x.argmin(axis=1)[:, None]
                best, where = np.hstack([best, np.take_along_axis(x, at, 1)]), np.hstack([where, at + a])
                np.put_along_axis(x, at, np.uint64(2**64 - 1), 1)
            if best.shape[1] > ELL:
                at = np.argpartition(best, ELL - 1, axis=1)[:, :ELL]
                best, where = np.take_along_axis(best, at, 1), np.take_along_axis(where, at, 1)
        order = np.argsort(where, axis=1)
        chosen = kmers[np.take_along_axis(where, order, 1)]
        one = np.zeros(SKETCHES, np.uint64)
        for i in range(chosen.shape[1]):
            one = _mix(one * _P + chosen[:, i])
    return (one >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words = _Words()
    for b in batches:
        k1, k2, sketches = [], [], []
        for text in b.column("text").to_pylist():
            h = word_hashes(text, words)
            raw = h.tobytes()
            k1.append(xxhash.xxh3_64_intdigest(raw) - (1 << 63) if raw else None)
            k2.append(xxhash.xxh64_intdigest(raw) - (1 << 63) if raw else None)
            sketches.append(sketch(labelled_kmers(h)) if raw else None)
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("tkey"), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()),
            pa.array(sketches, pa.list_(pa.int32()))], names=["doc_id", "tkey", "k1", "k2", "sk"])


def kmer_similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two texts' labelled k-mers, each sorted."""
    both = int(_held(a, b).sum())
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 0.0


def _held(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of a's elements b has; both sorted."""
    return b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a if len(b) else np.zeros(len(a), bool)


class _Masks(dict):
    """word -> bits at its positions in `words`; holds up to `most` bytes of them."""

    def __init__(self, words: np.ndarray, most: int = 32 << 20):
        order = np.argsort(words, kind="stable")
        self.order, self.sorted, self.size = order, words[order], len(words)
        self.room = most

    def __missing__(self, word: int) -> int:
        lo, hi = np.searchsorted(self.sorted, np.uint64(word), "left"), np.searchsorted(self.sorted, np.uint64(word), "right")
        if lo == hi:
            return 0
        bits = np.zeros(self.size, np.uint8)
        bits[self.order[lo:hi]] = 1
        mask = int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")
        cost = self.size // 8 + 64
        if cost <= self.room:
            self.room -= cost
            self[word] = mask
        return mask


def banded_matches(a: np.ndarray, b: np.ndarray, band: int) -> int:
    """The most words that an alignment matches whose pairs (i, j) lie within about `band` diagonals; never less than with
    |i - j| <= band. A row of the table is one integer, a bit for each word of b, so a row costs its band / 64 steps."""
    m, step = len(b), max(64, band // 2)
    row = (1 << m) - 1  # a zero where the count of matches rises
    for i in range(0, len(a), step):
        lo, hi = max(0, i - band), min(m, i + step + band)
        if lo >= hi:
            continue
        width = (1 << (hi - lo)) - 1
        masks, now = _Masks(b[lo:hi]), row >> lo & width
        for word in a[i : i + step].tolist():
            hit = now & masks[word]
            now = (now + hit | now - hit) & width
        row = row & ~(width << lo) | now << lo
    return m - row.bit_count()


def aligned(a: np.ndarray, b: np.ndarray, least: float = LEAST) -> bool:
    """Whether an alignment matches at least `least` of the longer word sequence."""
    longer = max(len(a), len(b))
    if min(len(a), len(b)) < least * longer:
        return False
    n = min(len(a), len(b))
    apart = np.flatnonzero(a[:n] != b[:n])
    head = int(apart[0]) if len(apart) else n
    a, b = a[head:], b[head:]
    n = min(len(a), len(b))
    apart = np.flatnonzero(a[::-1][:n] != b[::-1][:n])
    tail = int(apart[0]) if len(apart) else n
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    need = least * longer - head - tail - 1e-9
    if need <= 0:
        return True
    # insertions and deletions that still leave enough matches, hence the furthest diagonal of such an alignment
    band = int(len(a) + len(b) - 2 * need)
    return band >= 0 and banded_matches(a, b, band) >= need


class _Read(dict):
    """Word hashes and sorted k-mers by text, of the last texts of at most `most` words."""

    def __init__(self, words: _Words, most: int = 500_000):
        self.words, self.most, self.held = words, most, 0

    def __missing__(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        h = word_hashes(text, self.words)
        if self.held + len(h) > self.most:
            self.clear()
            self.held = 0
        self.held += len(h)
        found = self[text] = h, np.sort(labelled_kmers(h))
        return found


def near(a: str, b: str, read: _Read, least: float = LEAST) -> bool:
    (x, p), (y, q) = read[a], read[b]
    # the shorter k-mer set cannot be below `least` of the longer
    return min(len(p), len(q)) >= least * max(len(p), len(q)) and kmer_similarity(p, q) >= least and aligned(x, y, least)


_MET = "lead long, id long, near boolean, size long, lead_size long, shared long, held array<long>, other array<long>"


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each (lead, id) with their texts: near; k-mers of id and of lead; how many they share; which of lead's (sorted)
    k-mers id has, as a bitmap; id's others."""
    read = _Read(_Words())
    kinds = pa.schema([("lead", pa.int64()), ("id", pa.int64()), ("near", pa.bool_()), ("size", pa.int64()), ("lead_size", pa.int64()),
        ("shared", pa.int64()), ("held", pa.list_(pa.int64())), ("other", pa.list_(pa.int64()))])
    rows: list[tuple] = []
    weight = 0
    for b in batches:
        for lead, id_, text_l, text_x in zip(*(b.column(c).to_pylist() for c in ("lead", "id", "text_l", "text_x")), strict=True):
            (x, p), (y, q) = read[text_l], read[text_x]
            mine = _held(q, p)
            both = int(mine.sum())
            bits = np.zeros(-(-len(p) // 64) * 64, np.uint8)
            bits[: len(p)] = _held(p, q)
            good = both >= LEAST * (len(p) + len(q) - both) and aligned(x, y)
            rows.append((lead, id_, good, len(q), len(p), both, np.packbits(bits, bitorder="little").view(np.int64), q[~mine].view(np.int64)))
            weight += len(p) // 8 + 8 * (len(q) - both) + 64
            if weight > 4 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], schema=kinds)
                rows, weight = [], 0
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], schema=kinds)


def _near_only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    read = _Read(_Words())
    for b in batches:
        good = [near(x, y, read) for x, y in zip(b.column("text_l").to_pylist(), b.column("text_x").to_pylist(), strict=True)]
        yield b.select(["lead", "id"]).filter(pa.array(good, pa.bool_()))


def _renamed(edges: DataFrame, names: DataFrame) -> DataFrame:
    """Distinct edges (a > b) between what names (id, class) calls their ends; ends that it lacks stay."""
    one, two = names.select(F.col("id").alias("_i"), F.col("class").alias("_x")), names.select(F.col("id").alias("_j"), F.col("class").alias("_y"))
    ends = edges.join(one, F.col("a") == F.col("_i"), "left").join(two, F.col("b") == F.col("_j"),
        "left").select(F.coalesce("_x", "a").alias("x"), F.coalesce("_y", "b").alias("y"))
    return ends.where("x <> y").select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct()


def _followed(hooks: DataFrame) -> DataFrame:
    """id, class from pointers (a, b): the last one that a's way leads to. Two doublings a round."""
    while True:
        once = lambda h: h.join(h.select(F.col("a").alias("_a"), F.col("b").alias("_b")), F.col("b") == F.col("_a"), "left")
        twice = once(once(hooks).select("a", F.coalesce("_b", "b").alias("b")))
        hooks = stored(twice.select("a", F.coalesce("_b", "b").alias("b"), F.col("_b").isNotNull().alias("on")))
        if hooks.where("on").isEmpty():
            return hooks.select(F.col("a").alias("id"), F.col("b").alias("class"))


def components(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """labels (id, class) after all classes that edges (a, b; ids) connect became one, named by the least of them. A class
    hooks to its least neighbour if that is less than itself; pointers are followed to their ends; what edges are left join
    those. So long chains and large stars both take few rounds."""
    edges = stored(_renamed(edges, labels))
    while not edges.isEmpty():
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        names = _followed(stored(both.groupBy("a").agg(F.min("b").alias("b")).where("b < a")))
        to = names.select(F.col("id").alias("_id"), F.col("class").alias("_class"))
        labels = stored(labels.join(to, F.col("class") == F.col("_id"), "left").select("id", F.coalesce("_class", "class").alias("class")))
        edges = stored(_renamed(edges, names))
    return labels


def bands(sk: str) -> Column:
    """A 64-bit value for each band of ROWS sketches, in which the band's number counts."""
    return F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.xxhash64(i, F.slice(sk, i * ROWS + 1, ROWS)))


def stars(nodes: DataFrame) -> DataFrame:
    """lead, id of all nodes (id, sk) that share a bucket with the node that leads it."""
    spread = nodes.select("id", F.explode(F.array_distinct(bands("sk"))).alias("h"))
    # what is told of buckets is stored before it is joined back: a hot bucket's rows can then be dealt to several tasks
    shared = stored(spread.groupBy("h").agg(F.count("*").alias("n")).where("n > 1"))  # buckets of one node go at once
    buckets = stored(spread.join(shared, "h"))
    support = buckets.groupBy("id").agg(F.sum("n").alias("support"))
    lead = stored(buckets.join(support, "id").groupBy("h").agg(F.max(F.struct("support", -F.col("id"))).alias("m")).select("h", (-F.col("m.col2")).alias("lead")))
    return stored(buckets.select("h", "id").join(lead, "h").where("id <> lead").select("lead", "id").distinct())


def with_texts(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """lead, id, text_l, text_x; pairs of one leader come one after another."""
    one = pairs.join(texts.select(F.col("id").alias("_x"), F.col("text").alias("text_x")), F.col("id") == F.col("_x")).select("lead", "id", "text_x")
    return one.join(texts.select(F.col("id").alias("_l"), F.col("text").alias("text_l")), F.col("lead") == F.col("_l")).select("lead", "id", "text_l", "text_x")


def may_be_near(met: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs (lead, id) of nodes of one star that are in different classes and have similar k-mers, from what the comparisons
    with the leader told. met: as _MET; labels: id, class."""
    named = labels.select(F.col("id").alias("_id"), "class")
    of = met.join(named, F.col("id") == F.col("_id")).drop("_id").join(named.select(F.col("_id"), F.col("class").alias("lead_class")), F.col("lead") == F.col("_id")).drop("_id")
    of = of.withColumn("out", F.col("class") != F.col("lead_class"))
    open_ = of.where("out").select(F.col("lead").alias("_lead")).distinct()
    of = stored(of.join(open_, F.col("lead") == F.col("_lead"), "left_semi").drop("lead_class", "near"))
    alone = of.select("lead", "id", F.explode("other").alias("k")).groupBy("lead", "k").agg(F.count("*").alias("n"), F.min("id").alias("id")).where("n = 1")
    alone = alone.groupBy(F.col("lead").alias("_l"), F.col("id").alias("_i")).agg(F.count("*").alias("alone"))
    known = of.join(alone, (F.col("lead") == F.col("_l")) & (F.col("id") == F.col("_i")), "left")
    # a pair differs in alone + alone' + |held xor held'| k-mers at least; near ones in at most APART * (size + size')
    step = F.greatest(F.floor(F.col("lead_size") / STEPS), F.lit(1)).alias("step")
    need = (F.coalesce("alone", F.lit(0)) - APART * F.col("size")).alias("need")
    known = stored(known.select("lead", "id", "class", "out", "size", "shared", "held", "other", step, need))
    reach = F.col("size") * APART / LEAST - F.col("need")  # the other's size is at most size / LEAST
    far = lambda x: F.floor(F.greatest(F.least(x, F.col("step") * (STEPS + 1) * 2.0), F.lit(0.0)) / F.col("step"))
    at = F.explode(F.sequence(far(F.col("shared") - reach), far(F.col("shared") + reach))).alias("at")
    carried = ("class", "need", "size", "shared", "held", "other")
    one = known.where(F.col("out")).where(reach >= 0).select(F.col("lead").alias("l"), F.col("id").alias("x"), *(F.col(c).alias(f"x_{c}") for c in carried), at)
    two = known.select("lead", F.col("id").alias("y"), F.col("out").alias("y_out"), *(F.col(c).alias(f"y_{c}") for c in carried),
        F.floor(F.col("shared") / F.col("step")).alias("y_at"))
    same = (F.col("l") == F.col("lead")) & (F.col("at") == F.col("y_at")) & (F.col("x_class") != F.col("y_class")) & (~F.col("y_out") | (F.col("x") < F.col("y")))
    cheap = F.col("x_need") + F.col("y_need") + F.abs(F.col("x_shared") - F.col("y_shared")) <= 1e-6
    differ = F.aggregate(F.zip_with("x_held", "y_held", lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda n, k: n + k)
    apart = differ + F.size("x_other") + F.size("y_other") - 2 * F.size(F.array_intersect("x_other", "y_other"))
    met_again = one.join(two, same & cheap & (apart <= APART * (F.col("x_size") + F.col("y_size")) + 1e-6))
    return met_again.select(F.least("x", "y").alias("lead"), F.greatest("x", "y").alias("id")).distinct()


def classes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, tkey (hash of the text), class_id (the smallest doc_id of its class; null for a
    null doc_id), first (whether doc_id and tkey are the least of the class), words (whether
    the text has any)."""
    small_batches(docs.sparkSession)
    base = keyed(docs, id_col, text_col)
    rows = stored(base.mapInArrow(lean(_sketches), "doc_id long, tkey long, k1 long, k2 long, sk array<int>"))
    with_words = rows.where("k1 is not null and doc_id is not null")
    # one node for equal word sequences; its text is that of the smallest doc_id
    node = with_words.groupBy("k1", "k2").agg(F.min(F.struct("doc_id", "tkey")).alias("r"), F.first("sk").alias("sk"))
    nodes = stored(node.select(F.monotonically_increasing_id().alias("id"), "k1", "k2", F.col("r.doc_id").alias("rep"), F.col("r.tkey").alias("rep_key"), "sk"))
    star = stars(nodes.select("id", "sk"))
    used = star.select("id").union(star.select("lead")).distinct()
    keys = stored(nodes.select("id", "rep", "rep_key").join(used, "id"))
    wanted = F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys
    # rows that are equal in doc_id and text give a node's text more than once
    texts = stored(base.join(wanted, (F.col("doc_id") == F.col("rep")) & (F.col("tkey") == F.col("rep_key"))).select("id", "text").dropDuplicates(["id"]))
    labels = stored(used.select("id", F.col("id").alias("class")))
    met = stored(with_texts(star, texts).mapInArrow(lean(_compared), _MET))
    labels = components(met.where("near").select(F.col("lead").alias("a"), F.col("id").alias("b")), labels)
    again = stored(may_be_near(met, labels))
    late = with_texts(again, texts).mapInArrow(lean(_near_only), "a long, b long")
    labels = components(stored(late), labels)
    named = nodes.join(labels.select(F.col("id").alias("_id"), "class"), F.col("id") == F.col("_id"), "left").select("k1", "k2", "rep",
        "rep_key", F.coalesce("class", "id").alias("class"))
    least = named.groupBy("class").agg(F.min(F.struct("rep", "rep_key")).alias("m")).select(F.col("class").alias("_class"), "m")
    told = named.join(least, F.col("class") == F.col("_class")).select(F.col("k1").alias("_k1"), F.col("k2").alias("_k2"), "m")
    of_row = rows.select("doc_id", "tkey", "k1", "k2").join(told, (F.col("k1") == F.col("_k1")) & (F.col("k2") == F.col("_k2")) & F.col("doc_id").isNotNull(), "left")
    lone = F.col("m").isNull()
    return of_row.select("doc_id", "tkey", F.coalesce("m.rep", "doc_id").alias("class_id"),
        (lone | ((F.col("doc_id") == F.col("m.rep")) & (F.col("tkey") == F.col("m.rep_key")))).alias("first"), F.col("k1").isNotNull().alias("words"))


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, class_id (the smallest doc_id of its class)."""
    return classes(docs, id_col=id_col, text_col=text_col).select("doc_id", "class_id")


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each class: that of the least doc_id, of its texts the one of least hash, and of rows equal in
    both the one whose columns hash least. Documents without words and rows with a null doc_id stay, all of them."""
    of = stored(classes(docs, id_col=id_col, text_col=text_col))
    gone = stored(of.where("not first").select(F.col("doc_id").alias("_gone_id"), F.col("tkey").alias("_gone_key")).distinct())
    twice = stored(of.where("first and words and doc_id is not null").groupBy(F.col("doc_id").alias("_twice_id"),
        F.col("tkey").alias("_twice_key")).agg(F.count("*").alias("n")).where("n > 1"))
    hint = F.broadcast if gone.count() <= BROADCAST_KEYS else (lambda x: x)
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).cast("long").alias("id"), text_key(F.col(text_col).cast("string")).alias("key"))
    kept = rows.join(hint(gone), (F.col("id") == F.col("_gone_id")) & (F.col("key") == F.col("_gone_key")), "left_anti")
    if not twice.isEmpty():
        again = (F.col("id") == F.col("_twice_id")) & (F.col("key") == F.col("_twice_key"))
        order = Window.partitionBy("id", "key").orderBy(F.xxhash64("row"))
        one = kept.join(twice, again, "left_semi").withColumn("n", F.row_number().over(order)).where("n = 1").drop("n")
        kept = kept.join(twice, again, "left_anti").unionByName(one)
    return kept.select("row.*")


def op7_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
