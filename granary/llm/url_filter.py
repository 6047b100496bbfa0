"""URL filters: rules first, then host word segmentation and multinomial naive Bayes.

Host names are cut at dots and hyphens into labels; each distinct label is split into words by the best
sum of unigram log probabilities (Viterbi), the counts being those of the words of all pages' visible
text (words are runs of letters; those of over LONGEST letters are in no vocabulary, so that longer stretches count
as unknown). Words of hosts and paths, hashed into a fixed number of features, are scored by naive Bayes fitted
on all pages that a rule decides. Rules always win; the model decides the rest.

Defined cases: a null url, or one without ://, has an empty host and path and no rule; its verdict is the
model's for no tokens (the larger class; allow, if equal). Repeated rows each get their verdict; without
rule-decided pages everything else is allowed; an empty table gives an empty result; only page_id, url
and html are read; letters of any script are letters, without regard to case.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType

from .common import written

#: The contract's rules.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
#: Hashed features of the model, and the longest word that a label is split into.
FEATURES, LONGEST = 1 << 16, 24


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path, both empty for a null url or one without ://."""
    rest = F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)([^?#]*)", 1)
    path = F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)([^?#]*)", 2)
    return F.coalesce(F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit("")), F.coalesce(path, F.lit(""))


def judged_by_rules(host: Column, path: Column, rules=RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, else null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def unigrams(pages: DataFrame) -> DataFrame:
    """(word, n) over the visible text of all pages."""
    visible = F.regexp_replace(F.lower(F.coalesce(F.col("html"), F.lit(""))), r"<[^>]*>", " ")
    each = pages.select(F.explode(F.regexp_extract_all(visible, F.lit(r"\p{L}{2,}"), F.lit(0))).alias("word"))
    return each.where(F.length("word") <= LONGEST).groupBy("word").agg(F.count("*").alias("n"))


@F.pandas_udf(ArrayType(StringType()))
def _best_split(label: pd.Series, words: pd.Series, total: pd.Series) -> pd.Series:
    """Viterbi over a label's characters; words that aren't known cost 10 / (total * 10 ** length)."""

    def split(text: str, known, n: float) -> list[str]:
        cost = {w["word"]: math.log(w["n"] / n) for w in known}
        best = [(0.0, 0)]
        for end in range(1, len(text) + 1):
            best.append(max((best[at][0] + cost.get(text[at:end], math.log(10 / n) - math.log(10) * (end - at)), at) for at in range(max(0, end - LONGEST), end)))
        out, end = [], len(text)
        while end:
            out.append(text[best[end][1] : end])
            end = best[end][1]
        return out[::-1]

    return pd.Series([split(t, k if k is not None else [], max(float(n), 1.0)) for t, k, n in zip(label, words, total, strict=True)])


def segmented(labels: DataFrame, counts: DataFrame) -> DataFrame:
    """(label, words) for the distinct labels: their substrings are joined with the counts, so that no
    vocabulary has to fit anywhere. A label has at most LONGEST substrings a character."""
    total = counts.agg(F.sum("n")).first()[0] or 1
    ends = F.sequence(F.lit(1), F.least(F.lit(LONGEST), F.length("label")))
    subs = F.flatten(F.transform(ends, lambda n: F.transform(F.sequence(F.lit(1), F.length("label") - n + 1), lambda i: F.substring(F.col("label"), i, n))))
    one = labels.where("label <> ''").distinct()
    found = one.select("label", F.explode(F.array_distinct(subs)).alias("word")).join(counts, "word").groupBy("label").agg(F.collect_list(F.struct("word", "n")).alias("known"))
    return one.join(found, "label", "left").select("label", _best_split("label", "known", F.lit(float(total))).alias("words"))


def tokens(pages: DataFrame, counts: DataFrame) -> DataFrame:
    """pages with a column of feature numbers: of the host's words and the path's parts, digits alike."""
    cut = F.filter(F.split("host", r"[.\-:@]"), lambda x: x != "")
    hosts = pages.select("host").distinct().withColumn("labels", cut)
    words = segmented(hosts.select(F.explode("labels").alias("label")), counts)
    each = hosts.select("host", F.posexplode("labels").alias("at", "label")).join(words, "label")
    by_host = each.groupBy("host").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", "words"))), lambda x: x["words"])).alias("words"))
    by_host = written(by_host, "hosts")  # so that a host of many pages can be split in the join
    path = F.transform(F.filter(F.split("path", r"[^A-Za-z0-9]+"), lambda x: x != ""), lambda x: F.concat(F.lit("/"), F.lower(F.regexp_replace(x, "[0-9]+", "0"))))
    all_of = F.concat(F.coalesce("words", F.array().cast("array<string>")), path)
    return pages.join(by_host, "host", "left").withColumn("features", F.transform(all_of, lambda t: F.pmod(F.xxhash64(t), F.lit(FEATURES)).cast("int"))).withColumn("words", all_of)


def fit(decided: DataFrame) -> tuple[float, np.ndarray]:
    """Log odds of block over allow: of the classes, and of each feature with one added to each count.

    What comes to the driver is bounded by the number of features."""
    rows = decided.select("verdict", F.explode("features").alias("f")).groupBy("f").pivot("verdict", ["allow", "block"]).count().na.fill(0).collect()
    n = {r["verdict"]: r["count"] for r in decided.groupBy("verdict").count().collect()}
    if not n:
        return 0.0, np.zeros(FEATURES)
    counts = np.ones((2, FEATURES))
    for r in rows:
        counts[:, r["f"]] += r["allow"], r["block"]
    logs = np.log(counts / counts.sum(axis=1, keepdims=True))
    return math.log((n.get("block", 0) + 1) / (n.get("allow", 0) + 1)), logs[1] - logs[0]


def judge(pages: DataFrame) -> DataFrame:
    """page_id, host, path, rule, verdict, and the words that hosts and paths were split into, with the
    model's log odds."""
    host, path = parts(F.col("url"))
    own = pages.select("page_id", host.alias("host"), path.alias("path")).withColumn("by_rule", judged_by_rules(F.col("host"), F.col("path")))
    known = written(tokens(own, written(unigrams(pages), "unigrams")), "tokens")
    prior, weights = fit(known.where("by_rule IS NOT NULL").select("by_rule.verdict", "features"))

    @F.pandas_udf(DoubleType())
    def odds(features: pd.Series) -> pd.Series:
        return pd.Series([prior + float(weights[np.asarray(f, dtype=np.int64)].sum()) for f in features])

    scored = known.withColumn("odds", odds("features"))
    verdict = F.coalesce(F.col("by_rule.verdict"), F.when(F.col("odds") > 0, "block").otherwise("allow"))
    return scored.select("page_id", "host", "path", F.col("by_rule.rule").alias("rule"), verdict.alias("verdict"), F.col("words").alias("words"), F.round("odds", 6).alias("odds"))


def op10_url_filter(spark, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "host", "path", "rule", "verdict")


QUERIES, ORACLE = {"op10_url_filter": op10_url_filter}, {}
