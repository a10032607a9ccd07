"""Secret scan by multipart credential linking, in DataFrame functions only.

Strong findings stand alone: assignments to a secret's name, access identifiers of a known form, long hex runs. A long
random-looking token is weak: alone it says nothing. It is reported (kind `linked`) only if a complementary part of a
credential, an access identifier or an endpoint, begins or ends within `scope` code points of it in the same document. A
part that covers the token, such as the URL that it stands in, is not a second part. The link is returned: the nearest
part, of two as near the one before.

Parts of all kinds come out of one scan as rows. The interval join against the two kinds of complementary parts is a
merge: in each document, parts before are carried along the order of their ends and parts after along that of their starts,
so neither pairs nor cross products are made, and a document with very many parts costs n log n.

Defined cases: null and empty texts give a row without findings; rows that repeat a doc_id give a row each; a null
doc_id is kept; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import table

ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
IDENT = r"""(?i:access_?key_?id|client_?id|user_?name|user_?id|account|login)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@-]{3,}"""
ENDPOINT = r"""(?i:https?|ftps?|jdbc:[a-z0-9]+|postgres|postgresql|mysql|mongodb|redis|amqps?|s3)://[^\x00-\x20"'<>]{4,}"""
WEAK = r"[A-Za-z0-9+/_-]{20,}={0,2}"
#: Kinds in the order in which spans that start together are listed.
KINDS = ("assign", "access", "hex", "linked")
SCOPE = 200


def _parts(text: Column, kind: str, pattern: str, value_group: int = 0) -> Column:
    """An array of (kind, i, gap, length, value): each match with the length of what lies between it and the one before."""
    match = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(value_group)) if value_group else match
    gaps = F.split(text, pattern, -1)
    rows = F.transform(
        F.arrays_zip(match.alias("m"), value.alias("v"), F.slice(gaps, 1, F.size(match)).alias("g")),
        lambda x, i: F.struct(
            F.lit(kind).alias("kind"), i.alias("i"), F.char_length(x["g"]).cast("long").alias("gap"), F.char_length(x["m"]).cast("long").alias("length"), x["v"].alias("value")
        ),
    )
    none = F.array().cast("array<struct<kind:string,i:int,gap:bigint,length:bigint,value:string>>")
    return F.when(F.regexp_like(text, F.lit(pattern)), rows).otherwise(none)


def scan_secrets(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """One row per row of docs: doc_id, n_assign, n_access, n_hex, findings (array of start, rank, kind, end, link; code
    points; link: kind:start:end of the part that a weak candidate is reported for)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), text.alias("text"))
    t = F.col("text")
    scanned = base.select(
        "row",
        "doc_id",
        F.explode_outer(
            F.concat(_parts(t, "assign", ASSIGN, 1), _parts(t, "access", ACCESS), _parts(t, "hex", HEX), _parts(t, "ident", IDENT),
                _parts(t, "endpoint", ENDPOINT), _parts(t, "linked", WEAK))
        ).alias("p"),
    ).select("row", "doc_id", "p.*")
    # rows of a document meet once; both windows and the grouping below use that one exchange
    by_doc = scanned.repartition(F.col("row"))
    along = Window.partitionBy("row", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    placed = by_doc.withColumn("end", F.sum(F.col("gap") + F.col("length")).over(along)).withColumn("start", F.col("end") - F.col("length"))
    good = (
        F.col("kind").isNull()
        | F.col("kind").isin("access", "hex", "ident", "endpoint")
        | ((F.col("kind") == "assign") & (F.char_length("value") >= 8))
        | ((F.col("kind") == "linked") & F.col("value").rlike("[0-9]") & F.col("value").rlike("[A-Za-z]"))
    )
    placed = placed.withColumn("kind", F.when(good, F.col("kind")))
    strong, helper = F.col("kind").isin("assign", "access", "hex"), F.coalesce(F.col("kind").isin("access", "ident", "endpoint"), F.lit(False))
    order = Window.partitionBy("row").orderBy("start", "end")
    # a part before the token ends at its start or earlier, one after it begins at its end or later
    ends = Window.partitionBy("row").orderBy(F.when(helper, F.col("end")).otherwise(F.col("start")), F.when(helper, 0).otherwise(1)).rowsBetween(Window.unboundedPreceding, 0)
    starts = Window.partitionBy("row").orderBy(F.when(helper, F.col("start")).otherwise(F.col("end")), F.when(helper, 1).otherwise(0)).rowsBetween(0, Window.unboundedFollowing)
    linked = (
        placed.withColumn("strong_end", F.max(F.when(strong, F.col("end"))).over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("strong_start", F.min(F.when(strong, F.col("start"))).over(order.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("before", F.max(F.when(helper, F.struct("end", "start", "kind"))).over(ends))
        .withColumn("after", F.min(F.when(helper, F.struct("start", "end", "kind"))).over(starts))
        .withColumn("way_before", F.col("start") - F.col("before.end"))
        .withColumn("way_after", F.col("after.start") - F.col("end"))
    )
    near = F.least("way_before", "way_after") <= scope  # null where there is no part at all
    apart = (F.coalesce(F.col("strong_end"), F.lit(-1)) <= F.col("start")) & (F.coalesce(F.col("strong_start"), F.col("end")) >= F.col("end"))
    weak = F.col("kind") == "linked"
    first = F.coalesce(F.col("way_before") <= F.col("way_after"), F.col("way_after").isNull())
    part = lambda side: F.concat_ws(":", f"{side}.kind", F.col(f"{side}.start").cast("string"), F.col(f"{side}.end").cast("string"))
    link = F.when(weak, F.when(first, part("before")).otherwise(part("after")))
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    found = F.when(strong | (weak & near & apart), F.struct("start", rank.alias("rank"), "kind", "end", link.alias("link")))
    count = lambda kind: F.count(F.when(F.col("kind") == kind, 1)).alias(f"n_{kind}")
    return (
        linked.groupBy("row")
        .agg(F.first("doc_id").alias("doc_id"), count("assign"), count("access"), count("hex"), F.sort_array(F.collect_list(found)).alias("findings"))
        .drop("row")
    )


def _listed(findings: Column) -> Column:
    return F.array_join(F.transform(findings, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def op1_secrets(spark, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents"))
    base = F.filter("findings", lambda x: x["kind"] != "linked")
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(_listed(base), 256).alias("base_sha256"),
        _listed(F.col("findings")).alias("spans"), F.array_join(F.transform(F.filter("findings", lambda x: x["kind"] == "linked"), lambda x: x["link"]), ",").alias("links"))


def _sql_parts(kind: str, pattern: str, group: int = 0) -> str:
    p = pattern.replace("'", "''")
    return (
        f"select rid, '{kind}' kind, unnest(range(len(m))) i, unnest(m) m, unnest(v) v, unnest(g[:len(m)]) g from (select rid, regexp_extract_all(text, '{p}') m, "
        f"regexp_extract_all(text, '{p}', {group}) v, string_split_regex(text, '{p}') g from d)"
    )


ORACLE = f"""
with d as (select row_number() over () rid, doc_id, coalesce(text, '') as text from documents),
raw as ({" union all ".join(_sql_parts(*x) for x in (("assign", ASSIGN, 1), ("access", ACCESS), ("hex", HEX), ("ident", IDENT), ("endpoint", ENDPOINT), ("linked", WEAK)))}),
placed as (select rid, kind, v, length(m) len, sum(length(g) + length(m)) over (partition by rid, kind order by i) e from raw),
good as (select rid, kind, e - len as s, e from placed where kind in ('access','hex','ident','endpoint') or (kind = 'assign' and length(v) >= 8)
  or (kind = 'linked' and regexp_matches(v, '[0-9]') and regexp_matches(v, '[A-Za-z]'))),
weak as (select w.* from good w where kind = 'linked'
   and not exists (select 1 from good h where h.rid = w.rid and h.kind in ('assign','access','hex') and h.s < w.e and w.s < h.e)),
pairs as (select w.rid, w.s, w.e, h.kind hk, h.s hs, h.e he, case when h.e <= w.s then w.s - h.e else h.s - w.e end way, case when h.e <= w.s then 0 else 1 end side
   from weak w join good h on h.rid = w.rid and h.kind in ('access','ident','endpoint') and ((h.e <= w.s and w.s - h.e <= {SCOPE}) or (h.s >= w.e and h.s - w.e <= {SCOPE}))),
nearest as (select rid, s, e, hk || ':' || hs::bigint || ':' || he::bigint link from pairs
   qualify row_number() over (partition by rid, s, e order by way, side, case when side = 0 then -hs else he end, case when side = 0 then -ascii(hk[1]) else ascii(hk[1]) end) = 1),
found as (select rid, kind, s, e, null link from good where kind in ('assign','access','hex') union all select rid, 'linked', s, e, link from nearest),
per as (select rid, count(*) filter (kind = 'assign') a, count(*) filter (kind = 'access') b, count(*) filter (kind = 'hex') c,
  string_agg(kind || ':' || s::bigint || ':' || e::bigint, ',' order by s, list_position(['assign','access','hex','linked'], kind)) filter (kind <> 'linked') base,
  string_agg(kind || ':' || s::bigint || ':' || e::bigint, ',' order by s, list_position(['assign','access','hex','linked'], kind)) spans,
  string_agg(link, ',' order by s) filter (kind = 'linked') links
  from found group by rid)
select doc_id, coalesce(a, 0)::bigint n_assign, coalesce(b, 0)::bigint n_access, coalesce(c, 0)::bigint n_hex, sha256(coalesce(base, '')) base_sha256, coalesce(spans, '') spans, coalesce(links, '') links
from d left join per using (rid)
"""
