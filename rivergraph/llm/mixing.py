"""Mixing sources to target weights with hash-threshold histograms.

Sizes are summed by source and by the leading bits of a hash of the doc_id. The bucket in which a source's budget ends is
the only one refined, ten bits deeper each time, until it holds one hash value; a filter on that value is the whole
selection. Nothing is sorted and no document moves: an exchange carries sums by (source, bucket), combined before it.

A source's target is its share of all sizes by weight (5, 2, 1, repeating over the sources by code point, null last), at
most three times its size; what is cut off is shared again by weight. The target's whole multiples of the source repeat
every document; the rest selects documents by threshold, and the document at the threshold is taken if that comes nearer.

Defined cases: null and empty texts have size 0 and take 0; rows that repeat a doc_id share a hash and so a fate; a null
doc_id hashes as an empty string; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, table

WEIGHTS = (5, 2, 1)
MOST = 3
BITS, STEP = 60, 10
#: So many sources at most are joined by broadcast (under 50 MB of thresholds); beyond that the join is by shuffle.
BROADCAST_SOURCES = 200_000


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def sizes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    digest = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))
    return docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"),
        size_of(F.col(text_col).cast("string")).alias("size"), F.conv(F.substring(digest, 1, BITS // 4), 16, 10).cast("long").alias("h"))


def targets(sized: DataFrame, *, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """source, source_size, target; a row for each source."""
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    all_, ranked = Window.partitionBy(), Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(ranked) - 1) % len(weights) + 1).cast("int"))
    per = per.withColumn("w", weight.cast("long")).withColumn("cap", most * F.col("source_size")).withColumn("total", F.sum("source_size").over(all_))
    # sources fill up in the order of cap / weight; those before the first that its share doesn't fill are at their cap
    order = Window.orderBy((F.col("cap") / F.col("w")).asc(), F.col("source").asc_nulls_last())
    per = per.withColumn("left", F.col("total") - F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    per = per.withColumn("heavy", F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing))).withColumn("n", F.row_number().over(order))
    per = per.withColumn("free", F.min(F.when(F.col("left") * F.col("w") < F.col("cap") * F.col("heavy"), F.struct("n", "left", "heavy"))).over(all_))
    target = F.when(F.col("n") < F.coalesce(F.col("free.n"), F.lit(1 << 30)),
        F.col("cap").cast("double")).otherwise((F.col("free.left") * F.col("w")).cast("double") / F.col("free.heavy"))
    return per.select("source", "source_size", target.alias("target"))


def _thresholds(sized: DataFrame, goal: DataFrame, hint) -> DataFrame:
    """source, cut: a document is taken once more if its hash is at most cut."""
    state = stored(goal.select("source", "rest", F.lit(0).cast("long").alias("below"), F.lit(0).cast("long").alias("prefix")))
    done: list[DataFrame] = []
    for depth in range(STEP, BITS + 1, STEP):
        inside = sized.join(hint(state.withColumnRenamed("source", "s")), F.col("source").eqNullSafe(F.col("s")))
        if depth > STEP:
            inside = inside.where(F.shiftright("h", BITS - depth + STEP) == F.col("prefix"))
        sums = inside.groupBy("source", F.shiftright("h", BITS - depth).alias("bucket")).agg(
            F.sum("size").alias("size"), F.min("h").alias("low"), F.max("h").alias("high"), F.first("rest").alias("rest"), F.first("below").alias("below")
        )
        run = Window.partitionBy("source").orderBy("bucket")
        sums = sums.withColumn("to", F.col("below") + F.sum("size").over(run)).where(F.col("to") > F.col("rest"))
        edge = stored(sums.withColumn("k", F.row_number().over(run)).where("k = 1"))
        one = (F.col("low") == F.col("high")) | F.lit(depth == BITS)
        near = F.col("to") - F.col("rest") < F.col("rest") - (F.col("to") - F.col("size"))
        done.append(edge.where(one).select("source", F.when(near, F.col("high")).otherwise(F.col("low") - 1).alias("cut")))
        state = edge.where(~one).select("source", "rest", (F.col("to") - F.col("size")).alias("below"), F.col("bucket").alias("prefix"))
        if state.isEmpty():
            break
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """One row per row of docs: doc_id, source, size, source_size, target, times (0 to most), taken."""
    return _mixed(stored(sizes(docs, id_col=id_col, text_col=text_col, source_col=source_col)), weights, most)


def _mixed(sized: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    goal = targets(sized, weights=weights, most=most)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    goal = stored(goal.withColumn("whole", whole).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")))
    hint = F.broadcast if goal.count() <= BROADCAST_SOURCES else (lambda x: x)
    cuts = _thresholds(sized, goal.where("rest > 0"), hint)
    plan = goal.alias("g").join(cuts.alias("c"), F.col("g.source").eqNullSafe(F.col("c.source")),
        "left").select(F.col("g.source").alias("s"), "source_size", "target", "whole",
        F.coalesce("cut", F.when(F.col("rest") > 0, F.lit((1 << BITS) - 1)).otherwise(F.lit(-1))).alias("cut"))
    times = F.col("whole") + F.when(F.col("h") <= F.col("cut"), 1).otherwise(0)
    return sized.join(hint(plan), F.col("source").eqNullSafe(F.col("s"))).withColumn("times", times).select("doc_id", "source", "size",
        "source_size", "target", "times", (F.col("size") * F.col("times")).alias("taken"))


def apply_mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """docs with every row as often as the mix takes it; columns as in docs. Rows of size 0 go."""
    base = docs.select(F.struct(*docs.columns).alias("doc"), F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.col(source_col).alias("_source"))
    plan = mix(base, id_col="_id", text_col="_text", source_col="_source").where("taken > 0")
    plan = plan.select(F.col("doc_id").alias("_k"), F.col("source").alias("_s"), F.col("times").cast("int").alias("_n")).dropDuplicates(["_k", "_s"])
    kept = base.where(size_of(F.col("_text").cast("string")) > 0).join(plan, F.col("_id").eqNullSafe(F.col("_k")) & F.col("_source").cast("string").eqNullSafe(F.col("_s")))
    return kept.select("doc", F.explode(F.sequence(F.lit(1), F.col("_n")))).select("doc.*")


def op10_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


ORACLE = f"""
with z as (select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::bigint size, ('0x' || substr(md5(coalesce(doc_id::varchar, '')), 1, {BITS // 4}))::bigint h from documents),
p as (select source, sum(size)::bigint source_size, [{", ".join(map(str, WEIGHTS))}][((row_number() over (order by source nulls last) - 1) % {len(WEIGHTS)} + 1)::int] w from z group by source),
o as (select *, {MOST} * source_size cap, sum(source_size) over () total from p),
f as (select *, row_number() over q n, total - coalesce(sum(cap) over (q rows between unbounded preceding and 1 preceding), 0) rem,
  sum(w) over (q rows between current row and unbounded following) heavy from o window q as (order by cap / w, source nulls last)),
e as (select *, min(n) filter (rem * w < cap * heavy) over () fn from f),
t as (select source, source_size, case
  when n < coalesce(fn, 1000000000) then cap::double else (max(rem) filter (n = fn) over () * w)::double / (max(heavy) filter (n = fn) over ())::double end target from e),
a as (select *, case when source_size > 0 then floor(target / source_size)::bigint else 0 end whole from t),
r as (select *, target - whole * source_size rest from a),
c as (select z.*, r.source_size, r.target, r.whole, r.rest, sum(size) over (partition by z.source order by h range between unbounded preceding and current row) upto,
  sum(size) over (partition by z.source, h) same from z join r on z.source is not distinct from r.source)
select doc_id, size, source_size::bigint source_size, target, (size * (whole + case when rest > 0 and (upto <= rest or (upto - same <= rest
  and upto - rest < rest - (upto - same))) then 1 else 0 end))::bigint taken from c
"""
