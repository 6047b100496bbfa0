"""Secret scans by an incremental blob ledger.

Every version of a file is known by its content's SHA-256. A ledger holds (blob, rule version, spans)
for what has been scanned; a scan reads only the pairs that the ledger lacks, appends them, and joins
findings back to every path that has the content. DataFrame functions only.

Defined cases: a null or empty text is the empty blob, without findings; repeated rows each get the
blob's findings; an empty table gives an empty result; columns other than doc_id and text aren't read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import shared_dir, texts


@dataclass(frozen=True)
class Rule:
    """A kind of secret: matches of pattern, leftmost and not overlapping, whose group is long enough."""

    kind: str
    pattern: str
    group: int
    least: int

    @property
    def version(self) -> Column:
        """Changes with the pattern or the least length, so that a changed rule is scanned anew."""
        return F.sha2(F.lit(f"{self.kind}\0{self.pattern}\0{self.group}\0{self.least}"), 256)

    def spans(self, text: Column) -> Column:
        """array<struct<start,end>> in code points, end exclusive. The pieces between the matches and the
        matches themselves tell by their lengths where each match stands."""
        whole = F.regexp_extract_all(text, F.lit(self.pattern), F.lit(0))
        held = F.regexp_extract_all(text, F.lit(self.pattern), F.lit(self.group)) if self.group else whole
        pieces = F.split(text, self.pattern, -1)
        rows = F.arrays_zip(F.transform(pieces, F.length).alias("gap"), F.transform(whole, F.length).alias("size"), F.transform(held, F.length).alias("held"))

        def place(acc: Column, x: Column) -> Column:
            start = acc["at"] + x["gap"]
            end = start + x["size"]
            kept = F.when(x["held"] >= self.least, F.array(F.struct(start.alias("start"), end.alias("end")))).otherwise(F.array().cast("array<struct<start:int,end:int>>"))
            return F.struct(F.coalesce(end, acc["at"]).alias("at"), F.concat(acc["found"], kept).alias("found"))

        none = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("found"))
        return F.when(text.rlike(self.pattern), F.aggregate(rows, none, place, lambda acc: acc["found"])).otherwise(none["found"])


#: The three kinds, their patterns and least lengths.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]{32,}", 0, 32),
)


def scan(docs: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, blob, found: array<struct<kind, start, end>>) of every row; the ledger at that path grows."""
    spark = docs.sparkSession
    paths = texts(docs).select("doc_id", F.sha2(F.col("text"), 256).alias("blob"))
    blobs = texts(docs).groupBy(F.sha2(F.col("text"), 256).alias("blob")).agg(F.first("text").alias("text"))
    schema = "blob string, version string, kind string, spans array<struct<start:int,end:int>>"
    try:
        known = spark.read.schema(schema).parquet(ledger)
        seen = known.groupBy("blob").agg(F.collect_set("version").alias("seen"))  # as many as there are rule versions
        blobs = blobs.join(seen, "blob", "left")
    except Exception as error:  # the ledger's first use
        if "PATH_NOT_FOUND" not in str(error):
            raise
        blobs = blobs.withColumn("seen", F.lit(None).cast("array<string>"))
    pairs = [F.when(~F.coalesce(F.array_contains("seen", r.version), F.lit(False)), F.struct(r.version.alias("version"), F.lit(r.kind).alias("kind"), r.spans(F.col("text")).alias("spans"))) for r in rules]
    blobs.select("blob", F.explode(F.array_compact(F.array(*pairs))).alias("x")).select("blob", "x.*").write.mode("append").parquet(ledger)

    now = spark.read.schema(schema).parquet(ledger).where(F.col("version").isin(*[r.version for r in rules]) & (F.size("spans") > 0))
    found = now.groupBy("blob").agg(F.collect_set(F.struct("kind", "spans")).alias("kinds"))  # at most one for each rule
    each = F.flatten(F.transform("kinds", lambda k: F.transform(k["spans"], lambda s: F.struct(k["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))))
    return paths.join(found, "blob", "left").select("doc_id", "blob", F.coalesce(each, F.array().cast("array<struct<kind:string,start:int,end:int>>")).alias("found"))


def op1_secret_scan(spark, sf_dir: str) -> DataFrame:
    """The contract's digest of scan() over the whole of documents, from an empty ledger."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = scan(docs, f"{shared_dir(spark)}/ledger")
    order = F.create_map(*[F.lit(x) for i, r in enumerate(RULES) for x in (r.kind, i)])
    placed = F.array_sort(F.transform("found", lambda s: F.struct(s["start"].alias("start"), order[s["kind"]].alias("of"), s["end"].alias("end"), s["kind"].alias("kind"))))
    joined = F.array_join(F.transform("placed", lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return out.withColumn("placed", placed).withColumn("spans", joined).select("doc_id", *[count(r.kind) for r in RULES], F.sha2("spans", 256).alias("base_sha256"), "spans")



def _spans_sql(kind: str, pattern: str, group: int, least: int) -> str:
    p = pattern.replace("'", "''")
    gaps, sizes = f"list_transform(string_split_regex(t, '{p}'), lambda x: length(x))", f"list_transform(regexp_extract_all(t, '{p}', 0), lambda x: length(x))"
    return f"""(SELECT doc_id, '{kind}' AS kind, gs[1:i].list_sum() + coalesce(ss[1:i-1].list_sum(), 0) AS s, ss[i] AS n, hs[i] AS held, {least} AS least
    FROM (SELECT doc_id, gs, ss, hs, unnest(range(1, len(ss) + 1)) AS i
          FROM (SELECT doc_id, {gaps} AS gs, {sizes} AS ss, list_transform(regexp_extract_all(t, '{p}', {group}), lambda x: length(x)) AS hs
                FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents))))"""


ORACLE = {
    "op1_secret_scan": "WITH m AS ("
    + "\nUNION ALL ".join(f"SELECT *, {i} AS o FROM {_spans_sql(r.kind, r.pattern, r.group, r.least)}" for i, r in enumerate(RULES))
    + """), k AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
       string_agg(concat(kind, ':', CAST(s AS BIGINT), ':', CAST(s + n AS BIGINT)), ',' ORDER BY s, o) AS spans FROM m WHERE held >= least GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents d LEFT JOIN k USING (doc_id)"""
}
QUERIES = {"op1_secret_scan": op1_secret_scan}
