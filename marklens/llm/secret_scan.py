"""Secret scans with multipart credential linking, in DataFrame functions only.

1. Patterns give spans per kind: base kinds (assign, access, hex) and weak parts that mean little
   alone (key_id, key_secret, endpoint). Spark has no function for match positions, so a text is
   split at a pattern's matches: running sums of the lengths of gaps and matches are the positions.
2. Parts have a role: identifier (access, key_id), secret (assign, hex, key_secret) or endpoint. An
   interval join links each weak part with the parts of other roles that are at most SCOPE code points
   away, from the end of the earlier to the start of the later. Both sides carry the buckets of SCOPE
   code points that they cover, and the weak side its neighbour buckets too, so it is an equi-join; a
   pair counts in the first bucket that both carry. A part has at least 8 code points and parts of a
   kind don't overlap, so a bucket holds a bounded number of them: no document, however long or full
   of keys, makes more than a fixed number of pairs per part and bucket.
3. A key_id stays if a secret is near, a key_secret if an identifier is near, an endpoint if both are.

Defined cases: null text is empty and has no spans; repeated rows (same id and text) share one
result; rows with a null id keep their spans; very long texts are scanned whole; an empty table gives no rows; other
columns, whatever their names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: The base patterns.
ASSIGN = (
    r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"""
    r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ASSIGN_VALUE = 12
#: Runs of at least this length; as a run's first match is always the whole run (for access: its rest
#: from the first AKIA on), asking for the length in the pattern equals dropping short matches.
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
#: The method's own weak parts.
KEY_ID = r"[A-Z0-9]{16,}"
KEY_SECRET = r"[A-Za-z0-9+/]{32,}"
ENDPOINT = r"""[a-z][a-z0-9+.-]{1,15}://[^\x00-\x20"'<>]{4,}"""
SCOPE = 400
KINDS = ["assign", "access", "hex", "key_id", "key_secret", "endpoint"]
ROLES = {"assign": "secret", "access": "id", "hex": "secret", "key_id": "id", "key_secret": "secret", "endpoint": "endpoint"}
#: By kind: its pattern, and what tells cheaply that a text has no match.
PATTERNS = {
    "assign": (ASSIGN, r"text RLIKE '[Oo][Rr][Dd]|[Ss][Ww][Dd]|[Rr][Ee][Tt]|[Tt][Oo][Kk]|[Kk][Ee][Yy]'"),
    "access": (ACCESS, "contains(text, 'AKIA')"),
    "hex": (HEX, "text RLIKE '[0-9a-f]{16}'"),
    "key_id": (KEY_ID, "text RLIKE '[A-Z0-9]{16}'"),
    "key_secret": (KEY_SECRET, "text RLIKE '[A-Za-z0-9+/]{32}'"),
    "endpoint": (ENDPOINT, "contains(text, '://')"),
}


def found_parts(kind: str):
    """array<struct<kind, gap, hit, good>>: for each match, the length of the gap before it, its own
    length, and whether it counts."""
    pattern, maybe = PATTERNS[kind]
    hits, gaps = F.regexp_extract_all("text", F.lit(pattern), F.lit(0)), F.split("text", pattern, -1)

    def good(hit):
        if kind == "assign":
            return F.length(F.regexp_extract(hit, pattern, 2)) >= ASSIGN_VALUE
        if kind == "key_id":
            return hit.rlike("[0-9]") & hit.rlike("[A-Z]") & ~hit.startswith("AKIA")
        if kind == "key_secret":
            return hit.rlike("[0-9]") & hit.rlike("[A-Z]") & hit.rlike("[a-z]")
        return F.lit(True)

    part = lambda hit, gap: F.struct(F.lit(KINDS.index(kind)).alias("kind"), F.length(gap).alias("gap"), F.length(hit).alias("hit"), good(hit).alias("good"))
    # the last gap has no match behind it
    return F.when(F.expr(maybe), F.zip_with(hits, F.slice(gaps, 1, F.size(hits)), part)).otherwise(F.array().cast("array<struct<kind:int,gap:int,hit:int,good:boolean>>"))


def secret_parts(docs: DataFrame) -> DataFrame:
    """doc_id, row_key, kind, start_at, end_at, near: all spans, weak ones with what is near them."""
    rows = docs.select("doc_id", "row_key", *(found_parts(k).alias(k) for k in KINDS))
    rows = rows.select("doc_id", "row_key", F.concat(*KINDS).alias("parts")).where("size(parts) > 0").dropDuplicates(["doc_id", "row_key"])
    parts = rows.select("doc_id", "row_key", F.posexplode("parts").alias("at", "p")).select("doc_id", "row_key", "at", "p.*")
    upto = Window.partitionBy("doc_id", "row_key", "kind").orderBy("at")
    end_at = F.sum(F.col("gap") + F.col("hit")).over(upto.rowsBetween(Window.unboundedPreceding, 0))
    parts = parts.withColumn("end_at", end_at).withColumn("start_at", F.col("end_at") - F.col("hit")).where("good")
    return common.written(parts.select("doc_id", "row_key", "kind", "start_at", "end_at"))


def linked(parts: DataFrame) -> DataFrame:
    """Base spans, and the weak spans near which their complements are."""
    role = F.element_at(F.array(*(F.lit(ROLES[k]) for k in KINDS)), F.col("kind") + 1)
    first, last = F.floor(F.col("start_at") / SCOPE), F.floor(F.col("end_at") / SCOPE)
    parts = parts.withColumn("role", role).withColumn("first", first)
    weak = parts.where(F.col("kind") >= KINDS.index("key_id")).withColumn("first", F.col("first") - 1)
    weak = weak.withColumn("bucket", F.explode(F.sequence("first", last + 1)))
    others = parts.withColumn("bucket", F.explode(F.sequence("first", last)))
    others = others.select(*(F.col(c).alias(f"o_{c}") for c in ("doc_id", "row_key", "bucket", "first", "role", "start_at", "end_at")))
    gap = "greatest(start_at, o_start_at) - least(end_at, o_end_at)"
    near = weak.join(
        others,
        F.expr(f"row_key = o_row_key AND bucket = o_bucket AND doc_id <=> o_doc_id AND role <> o_role AND bucket = greatest(first, o_first) AND {gap} <= {SCOPE}"),
        "left_outer",
    )
    near = near.groupBy("doc_id", "row_key", "kind", "start_at", "end_at").agg(
        F.coalesce(F.bool_or(F.col("o_role") == "id"), F.lit(False)).alias("id"), F.coalesce(F.bool_or(F.col("o_role") == "secret"), F.lit(False)).alias("secret")
    )
    kept = F.when(F.col("kind") == KINDS.index("key_id"), F.col("secret")).when(F.col("kind") == KINDS.index("key_secret"), F.col("id")).otherwise(F.col("id") & F.col("secret"))
    columns = ["doc_id", "row_key", "kind", "start_at", "end_at"]
    return parts.where(F.col("kind") < KINDS.index("key_id")).select(columns).unionByName(near.where(kept).select(columns))


def secret_scan(docs: DataFrame) -> DataFrame:
    """One row per input row: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_weak."""
    rows = docs.select("doc_id", common.whole_text().alias("text")).withColumn("row_key", F.xxhash64("text"))
    names = F.array(*map(F.lit, KINDS))
    shown = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start_at"], s["end_at"])), ",")
    count = lambda kind: F.count(F.when(F.col("kind") == KINDS.index(kind), 1))
    by_row = linked(secret_parts(rows)).groupBy(F.col("doc_id").alias("s_doc_id"), F.col("row_key").alias("s_row_key")).agg(
        *(count(k).alias(f"n_{k}") for k in ("assign", "access", "hex")),
        F.count(F.when(F.col("kind") >= KINDS.index("key_id"), 1)).alias("n_weak"),
        F.array_sort(F.collect_list(F.struct("start_at", "kind", "end_at"))).alias("spans"),
    )
    base = lambda s: s["kind"] < KINDS.index("key_id")
    by_row = by_row.select("*", shown(F.filter("spans", base)).alias("base"), shown(F.col("spans")).alias("shown"))
    out = rows.select("doc_id", "row_key").join(by_row, F.expr("row_key = s_row_key AND doc_id <=> s_doc_id"), "left_outer")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return out.select(
        "doc_id", zero("n_assign"), zero("n_access"), zero("n_hex"), F.sha2(F.coalesce("base", F.lit("")), 256).alias("base_sha256"),
        F.coalesce("shown", F.lit("")).alias("spans"), zero("n_weak"),
    )


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(common.table(spark, sf_dir, "documents"))


def _sql_kind(kind: str) -> str:
    quoted = PATTERNS[kind][0].replace("'", "''")
    good = {
        "assign": f"length(regexp_extract(hit, '{quoted}', 2)) >= {ASSIGN_VALUE}",
        "key_id": "regexp_matches(hit, '[0-9]') AND regexp_matches(hit, '[A-Z]') AND NOT starts_with(hit, 'AKIA')",
        "key_secret": "regexp_matches(hit, '[0-9]') AND regexp_matches(hit, '[A-Z]') AND regexp_matches(hit, '[a-z]')",
    }.get(kind, "true")
    return (
        f"SELECT rid, {KINDS.index(kind)} AS kind, '{ROLES[kind]}' AS role, start_at, start_at + length(hit) AS end_at FROM ("
        f"SELECT rid, hit, sum(length(gap) + length(hit)) OVER (PARTITION BY rid ORDER BY i) - length(hit) AS start_at FROM ("
        f"SELECT rid, unnest(regexp_extract_all(t, '{quoted}')) AS hit, unnest(regexp_split_to_array(t, '{quoted}')) AS gap,"
        f" unnest(range(len(regexp_split_to_array(t, '{quoted}')))) AS i FROM d) WHERE hit IS NOT NULL) WHERE {good}"
    )


_NAMES = "[" + ", ".join(f"'{k}'" for k in KINDS) + "]"
ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
p AS ({" UNION ALL ".join(map(_sql_kind, KINDS))}),
w AS (
  SELECT a.rid, a.kind, a.start_at, a.end_at, coalesce(bool_or(b.role = 'id'), false) AS id, coalesce(bool_or(b.role = 'secret'), false) AS secret
  FROM p a LEFT JOIN p b ON a.rid = b.rid AND a.role <> b.role AND greatest(a.start_at, b.start_at) - least(a.end_at, b.end_at) <= {SCOPE}
  WHERE a.kind >= 3 GROUP BY ALL),
s AS (
  SELECT rid, kind, start_at, end_at FROM p WHERE kind < 3
  UNION ALL SELECT rid, kind, start_at, end_at FROM w WHERE CASE kind WHEN 3 THEN secret WHEN 4 THEN id ELSE id AND secret END),
g AS (
  SELECT rid, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
    count(*) FILTER (kind >= 3) AS n_weak,
    string_agg(({_NAMES})[kind + 1] || ':' || start_at || ':' || end_at, ',' ORDER BY start_at, kind) FILTER (kind < 3) AS base,
    string_agg(({_NAMES})[kind + 1] || ':' || start_at || ':' || end_at, ',' ORDER BY start_at, kind) AS spans
  FROM s GROUP BY rid)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_weak, 0) AS n_weak
FROM d LEFT JOIN g USING (rid)
"""
