"""Benchmark decontamination: a broadcast hash set of normalised test n-grams against the windows of every document.

DataFrame functions only. One scan: a document's words become an array, each window of it a 64-bit hash, and each hash
is looked up in a bitmap of the benchmark's n-grams (a one-row subquery). Only windows that pass become rows, with their
words; the equi-join with the n-grams themselves is the verification, so a hash collision never counts. The rows of a
document meet in one exchange that carries no text.

The benchmark's n-grams are broadcast while they measure at most `broadcast_bytes` in text; beyond that the same join
shuffles both sides by n-gram. The bitmap stays at 64 bits a gram up to 2**26 bits (8 MB); beyond that more windows pass.

Defined cases: null and empty texts have no words and no hits, and are never contaminated; an item of no words has no
window; rows that repeat a doc_id give a row each; a null item_id is never listed, but its windows hit; further columns
are ignored, and decontaminate keeps them; an empty benchmark hits nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, stored, table, text_key

N = 13
#: Characters that part words: those below \x80 that are neither digits nor letters, and capitals to be made small.
SEPARATORS = "".join(chr(c) for c in range(128) if not chr(c).isalnum())
BROADCAST_BYTES = 64 << 20


def words(text: Column) -> Column:
    """Lower-cased (A-Z only) words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+."""
    plain = F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER + SEPARATORS, LOWER + " " * len(SEPARATORS))
    return F.filter(F.split(plain, " "), lambda w: w != "")


def benchmark_grams(benchmark: DataFrame, *, n: int = N, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """gram (its words joined by a space), len (words), items (ids as strings)."""
    w = benchmark.select(F.col(item_col).cast("string").alias("item"), words(F.col(text_col)).alias("w"))
    length = F.least(F.size("w"), F.lit(n))
    starts = F.sequence(F.lit(1), F.size("w") - length + 1)
    gram = F.transform(starts, lambda i: F.array_join(F.slice("w", i, length), " "))
    one = w.where(F.size("w") > 0).select("item", length.alias("len"), F.explode(F.array_distinct(gram)).alias("gram"))
    return one.groupBy("gram").agg(F.first("len").alias("len"), F.sort_array(F.collect_set("item")).alias("items"))


def _bitmap(grams: DataFrame, bits: int) -> DataFrame:
    """One row, one array of bits / 64 longs in which the bit of each gram's hash is set."""
    h = F.xxhash64(F.split("gram", " "))
    slot = F.shiftrightunsigned(h, 6).bitwiseAND(F.lit(bits // 64 - 1))
    bit = F.expr("shiftleft(1L, cast(xxhash64(split(gram, ' ')) & 63 as int))")
    filled = grams.select(slot.alias("slot"), bit.alias("bit")).groupBy("slot").agg(F.bit_or("bit").alias("bit"))
    every = grams.sparkSession.range(bits // 64).toDF("slot").join(filled, "slot", "left").select("slot", F.coalesce("bit", F.lit(0)).alias("bit"))
    return every.agg(F.transform(F.array_sort(F.collect_list(F.struct("slot", "bit"))), lambda x: x["bit"]).alias("map"))


def find_contamination(docs: DataFrame, benchmark: DataFrame, *, n: int = N, id_col: str = "doc_id", text_col: str = "text", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """One row per row of docs: doc_id, tkey (hash of the text), n_words, n_hit, spans (sorted, disjoint [from, to) of
    words that are hit), items (ids of the items whose windows occur, sorted as strings)."""
    grams = benchmark_grams(benchmark, n=n)
    size = grams.agg(F.count("*").alias("n"), F.sum(F.length("gram") + F.length(F.array_join("items", ","))).alias("bytes"),
        F.sort_array(F.collect_set("len")).alias("lens")).first()
    bits = min(1 << 26, max(1 << 12, 1 << (64 * size["n"]).bit_length()))
    base = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), text_key(text_col).alias("tkey"), words(F.col(text_col)).alias("w"))
    none = F.array().cast("array<struct<i:int,len:int,gram:string>>")
    bitmap = _bitmap(grams, bits).scalar()

    def passing(length: int) -> Column:
        hashes = F.transform(F.sequence(F.lit(1), F.size("w") - (length - 1)), lambda i: F.xxhash64(F.slice("w", i, length)))

        def test(h: Column, i: Column) -> Column:
            slot = F.shiftrightunsigned(h, 6).bitwiseAND(F.lit(bits // 64 - 1)).cast("int")
            return F.when(F.getbit(F.get("map", slot), h.bitwiseAND(F.lit(63)).cast("int")) == 1, i)

        kept = F.filter(F.transform(hashes, test), lambda i: i.isNotNull())
        rows = F.transform(kept, lambda i: F.struct(i.alias("i"), F.lit(length).alias("len"), F.array_join(F.slice("w", i + 1, length), " ").alias("gram")))
        return F.when(F.size("w") >= length, rows).otherwise(none)

    scanned = base.withColumn("map", bitmap).select(
        "row", "doc_id", "tkey", F.size("w").cast("long").alias("n_words"), F.explode_outer(F.concat(none, *(passing(k) for k in size["lens"]))).alias("p")
    ).select("row", "doc_id", "tkey", "n_words", "p.*")
    side = grams.select("gram", "items")
    if (size["bytes"] or 0) <= broadcast_bytes:
        side = F.broadcast(side)
    hits = scanned.join(side, "gram", "left").withColumn("span", F.when(F.col("items").isNotNull(), F.struct(F.col("i").alias("from"), (F.col("i") + F.col("len")).alias("to"))))
    found = hits.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"),
        F.first("tkey").alias("tkey"),
        F.first("n_words").alias("n_words"),
        F.sort_array(F.collect_set("span")).alias("raw"),
        F.collect_set("items").alias("items"),
    )
    start = F.struct(F.lit(0).alias("to"), F.lit(0).cast("long").alias("n"))
    step = lambda a, x: F.struct(F.greatest(a["to"], x["to"]).alias("to"), (a["n"] + F.greatest(F.lit(0), x["to"] - F.greatest(a["to"], x["from"]))).alias("n"))
    return found.select("doc_id", "tkey", "n_words", F.aggregate("raw", start, step, lambda a: a["n"]).alias("n_hit"),
        F.col("raw").alias("spans"), F.array_sort(F.array_distinct(F.flatten("items"))).alias("items"))


def contaminated() -> Column:
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def _with(value: Column, use) -> Column:
    """use(value), where value is evaluated once however often use names it: an element of a one-element array."""
    return F.transform(F.array(value), use)[0]


def without_spans(text: Column, spans: Column) -> Column:
    """text without the words in spans ([from, to) of word numbers, from 0), each with the separators before it."""
    token = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*[A-Za-z0-9\u0080-\x{10FFFF}]+(?:[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+$)?"
    hit = F.flatten(F.transform(spans, lambda s: F.sequence(s["from"], s["to"] - 1)))
    kept = lambda pieces: F.array_except(F.sequence(F.lit(0), F.size(pieces) - 1), hit)
    # the pieces are bound to a name: inside the inner lambda the expression itself would run once a word
    return _with(F.regexp_extract_all(text, F.lit(token), F.lit(0)),
        lambda pieces: F.when(F.size(pieces) > 0, F.array_join(F.transform(kept(pieces), lambda i: F.get(pieces, i)), "")).otherwise(F.lit("")))


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, n: int = N, id_col: str = "doc_id", text_col: str = "text", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """docs without contaminated rows (hits cover a twentieth of the words or more); from other rows with hits, the words
    that are hit go, each with the separators before it. Columns as in docs, whatever their names; n_chars follows the text
    if it is there. What was found is broadcast while it measures at most broadcast_bytes, else joined by shuffle."""
    found = find_contamination(docs, benchmark, n=n, id_col=id_col, text_col=text_col).where("n_hit > 0")
    # a contaminated row needs no spans
    found = stored(found.select(F.col("doc_id").alias("id"), F.col("tkey").alias("key"), contaminated().alias("bad"),
        F.when(~contaminated(), F.col("spans")).alias("spans")).dropDuplicates(["id", "key"]))
    size = found.agg(F.sum(64 + 16 * F.greatest(F.size("spans"), F.lit(0)))).first()[0] or 0
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("row_id"), text_key(F.col(text_col).cast("string")).alias("row_key"))
    joined = rows.join(F.broadcast(found) if size <= broadcast_bytes else found,
        F.col("row_id").eqNullSafe(F.col("id")) & (F.col("row_key") == F.col("key")), "left").where(~F.coalesce("bad", F.lit(False)))
    text = F.col("row").getField(text_col)
    cut = joined.withColumn("cut", F.when(F.col("spans").isNotNull(), without_spans(text, F.col("spans"))).otherwise(text))

    def column(f) -> Column:
        if f.name == text_col:
            return F.col("cut").alias(f.name)
        old = F.col("row").getField(f.name)
        return (F.when(F.col("spans").isNotNull(), F.char_length("cut").cast(f.dataType)).otherwise(old) if f.name == "n_chars" else old).alias(f.name)

    return cut.select(*map(column, docs.schema))


def op9_decontamination(spark, sf_dir: str) -> DataFrame:
    found = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), contaminated().alias("contaminated"))


_SQL_WORDS = f"list_filter(string_split(translate(coalesce(text, ''), '{UPPER}' || list_aggregate(list_transform(c, lambda x: chr(x)), 'string_agg', ''), '{LOWER}' || repeat(' ', len(c))), ' '), lambda x: x <> '')"
ORACLE = f"""
with k as (select list_filter(range(1, 128), lambda x: not (x between 48 and 57 or x between 65 and 90 or x between 97 and 122))::int[] c),
d as (select row_number() over () rid, doc_id, {_SQL_WORDS} w from documents, k),
b as (select item_id::varchar item, {_SQL_WORDS} w from benchmark, k),
g as (select distinct item, least(len(w), {N}) l, unnest(list_transform(range(1, len(w) - least(len(w), {N}) + 2), lambda i: array_to_string(w[i:i + least(len(w), {N}) - 1], ' '))) gram
  from b where len(w) > 0),
s as (select rid, i, l, array_to_string(w[i:i + l - 1], ' ') gram from (select rid, w, l, unnest(range(1, len(w) - l + 2)) i from d, (select distinct l from g))),
h as (select rid, i, s.l, item from s join g on s.gram = g.gram and s.l = g.l),
p as (select rid, count(distinct x) n from (select rid, unnest(range(i, i + l)) x from h) group by rid),
q as (select rid, count(distinct item) n, string_agg(distinct item, ',' order by item) items from h group by rid)
select doc_id, len(w)::bigint n_words, coalesce(p.n, 0)::bigint n_hit, coalesce(q.n, 0)::bigint n_items, sha256(coalesce(items, '')) items_sha256,
  coalesce(p.n, 0) > 0 and 20 * coalesce(p.n, 0) >= len(w) contaminated
from d left join p using (rid) left join q using (rid)
"""
