"""Corpus pipeline: documents through five stages, each of them one operator of granary.llm.

Every stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; between stages
rows are Parquet. All but the last return the columns of documents, and leave those they don't know as they are,
whatever their names; an empty table stays empty."""

from pyspark.sql import functions as F

from granary.llm import common, mixing, ngram_join, packing, pii, quality


def good(spark, docs, sf_dir):
    """Documents whose probability of the highest grade is high enough; a null text is an empty one, and rows that are the same
    fare alike. Without labels all stay."""
    return quality.selected(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def different(spark, docs, sf_dir):
    """One document of each group linked by five-word shingles at 0.8 or more: of the smallest doc_id, null last.

    Rows are told apart by all of their columns, not by doc_id: a null doc_id is a document like any other, and
    rows of one doc_id with different texts are different documents. Rows without words link to nothing and all stay."""
    row, component, empty, n = (common.fresh(docs, c) for c in ("_row", "_component", "_empty", "_n"))
    cells = [F.col(f"`{c}`").cast("string") for c in docs.columns]
    keyed = docs.withColumn(row, F.sha2(F.concat(*[F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in cells]), 256))
    with common.scratch(spark):
        linked = ngram_join.Join(keyed.select(F.col(row).alias("doc_id"), "text"), 5, 80, 100).run()
        linked = linked.groupBy(F.col("doc_id").alias(row), F.col("component_id").alias(component), (F.col("n_shingles") == 0).alias(empty)).agg(F.count("*").alias(n))
        rows = common.written(linked, "rows", keep=True)
    ids = keyed.select(row, "doc_id").distinct()
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col(row), F.col(n))).alias("least")
    kept = rows.where(~F.col(empty)).join(ids, row).groupBy(component).agg(least).select(F.col("least")[row].alias(row), F.col("least")[n].alias(n))
    kept = common.written(kept.unionAll(rows.where(empty).select(row, F.lit(1).cast("long").alias(n))), "kept")  # those without words all stay
    out = keyed.join(kept.where(F.col(n) == 1), row).select(*docs.columns)
    again = kept.where(F.col(n) > 1)  # rows that are the same in all columns: one of them
    return out if again.isEmpty() else out.unionAll(keyed.join(again, row).dropDuplicates([row]).select(*docs.columns))


def private(spark, docs, sf_dir):
    """Personal data replaced by its kind; a null text stays null."""
    return pii.redacted(docs)


def mixed(spark, docs, sf_dir):
    """Documents as often as the mix takes them; where it takes a part, the text up to that word. A null source is a source of its
    own; documents without words are never taken."""
    return mixing.applied(docs)


def packed(spark, docs, sf_dir):
    """Pieces with their places in sequences; a null text is one piece, the end mark."""
    return packing.packed(packing.pieces(docs))


STAGES = [("quality", good), ("near_duplicates", different), ("pii", private), ("mixing", mixed), ("packing", packed)]
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = common.written(stage(spark, docs, sf_dir), name)
    return docs
