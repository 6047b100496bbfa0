"""Mixing sources to target weights by a low-discrepancy schedule.

Slot k takes the golden-ratio point frac(k * phi), which falls into one source's part of the cumulative target
weights. Slots are ranked within their source, and rank r takes the r-th block of words that the source's shuffled
documents make when laid end to end, up to MOST times over. All blocks of all sources have the same number of words
(the last of a source may run out), so how many slots fall to a source decides what the mix takes of it.
DataFrame functions only.

How near targets come: of n golden-ratio points an interval of share p gets n * p within a few (the tests ask for at most
4), so words taken are within as many blocks of the target, of which there are about SLOTS or more.

Defined cases: a null text has no words; a null source is a source of its own, last in order; documents without
words are never taken (0); a source that no point falls to gets one slot; an empty table gives an empty result; repeated
rows are documents of their own; columns other than doc_id, text and source aren't read, and any others, whatever
their names, come through applied() as they were.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, ranked, running, written

#: Blocks hold the total's words over SLOTS, but 1 to WIDEST: there are about SLOTS slots, beyond WIDEST * SLOTS words more.
SLOTS, WIDEST = 1 << 20, 4096
#: The weights that sources get in their order, again and again, and the most times a source is repeated.
WEIGHTS = (5, 2, 1)
MOST = 3
#: Parts of all points by which they meet the sources' intervals (more, if there are more sources); an equality for the join, not a limit.
CELLS = 1024
#: Slots to a window when they are ranked.
CHUNK = 1024
PHI = 0.6180339887498949
#: Units of a word in which targets are laid side by side, as whole numbers.
UNITS = 1024
_SPACE = r"\x20\x09-\x0D"


def words(text: Column) -> Column:
    """How many runs of characters other than space and \\t to \\r the text has; null: 0."""
    return F.coalesce(F.size(F.filter(F.split(text, f"[{_SPACE}]+"), lambda w: w != "")), F.lit(0)).cast("long")


def beginning(text: Column, n: Column) -> Column:
    """The text up to its n-th word's end."""
    return F.array_join(F.slice(F.split(text, f"(?<=[^{_SPACE}])(?=[{_SPACE}])"), 1, n.cast("int")), "")


def in_order() -> list[Column]:
    return [F.col("source").isNull(), F.col("source")]


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size) -> with target. A source is full when, with the share at which it fills, all
    sources together take no more than there is; sorted by that share, prefix sums tell."""
    s = running(sources, in_order(), {"place": F.lit(1)})
    s = s.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int")).cast("long"))
    s = running(s.withColumn("cap", F.col("source_size") * most), [F.col("cap") / F.col("w"), *in_order()], {"w_before": F.col("w"), "cap_before": F.col("cap")})
    s = s.join(F.broadcast(s.agg(F.sum("w").alias("all_w"), F.sum("source_size").alias("all_size"))), F.lit(True))  # one row
    left = lambda a, b: (F.col(a) - F.col(b)).cast("decimal(19,0)")
    full = F.col("cap").cast("decimal(19,0)") * left("all_w", "w_before") <= left("all_size", "cap_before") * F.col("w").cast("decimal(19,0)")
    s = written(s.withColumn("full", full), "full")
    rest = s.agg(F.sum(F.when(F.col("full"), F.col("cap"))).alias("taken"), F.sum(F.when(~F.col("full"), F.col("w"))).alias("free"))
    s = s.join(F.broadcast(rest), F.lit(True))  # one row
    target = F.when(F.col("full"), F.col("cap").cast("double")).otherwise((F.col("all_size") - F.coalesce("taken", F.lit(0))).cast("double") * F.col("w") / F.col("free"))
    return s.select("source", "source_size", target.alias("target"))


def schedule(goal: DataFrame, slots: int, phi: float = PHI) -> DataFrame:
    """(source, place, rank, n_slots): the order in which sources give blocks, ranked within each source."""
    spark = goal.sparkSession
    laid = goal.where("target > 0").select("source", F.greatest(F.round(F.col("target") * UNITS), F.lit(1.0)).cast("long").alias("units"))
    parts = written(running(laid, in_order(), {"key": F.lit(1), "lo": F.col("units")}).withColumn("hi", F.col("lo") + F.col("units")), "parts")
    n, total = parts.agg(F.count("*"), F.sum("units")).first()
    if not n:
        return spark.createDataFrame([], f"source {goal.schema['source'].dataType.simpleString()}, place double, rank long, n_slots long")
    width = total // max(CELLS, n) + 1
    cells = parts.withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor((F.col("hi") - 1) / width))))
    points = spark.range(slots).select("id", F.least(F.floor(F.col("id") * phi % 1.0 * float(total)), F.lit(total - 1)).alias("at")).withColumn("cell", F.floor(F.col("at") / width))
    hit = points.join(cells, "cell").where("at >= lo AND at < hi").select("source", "key", F.col("id").cast("double").alias("place"))
    hit = written(hit, "hits")
    missed = parts.join(hit.select("key").distinct(), "key", "left_anti").select("source", "key", ((F.col("lo") + F.col("hi")) / 2.0 / float(total) * slots - 0.5).alias("place"))
    both = hit.unionAll(missed).withColumn("chunk", F.floor(F.col("place") / CHUNK))
    inside = Window.partitionBy("key", "chunk").orderBy("place")
    sums = both.groupBy("key", "chunk").count()
    before = Window.partitionBy("key").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("start", F.coalesce(F.sum("count").over(before), F.lit(0))).withColumn("n_slots", F.sum("count").over(Window.partitionBy("key"))).drop("count")
    return both.withColumn("in", F.row_number().over(inside)).join(starts, ["key", "chunk"]).select("source", "place", (F.col("start") + F.col("in") - 1).alias("rank"), "n_slots")


def mix(docs: DataFrame, row: str | None = None, slots: int = SLOTS, phi: float = PHI) -> tuple[DataFrame, DataFrame, int]:
    """(line, draws, width): line is (row, doc_id, source, size, source_size, target); draws is (row, place, words): how many
    words of the document the slot at that place takes; width is the words of a block. row names a column of docs that
    tells rows apart; without it they get numbers."""
    number = F.col(row).alias("row") if row else F.monotonically_increasing_id().alias("row")
    sized = written(docs.select(number, "doc_id", "source", words(F.col("text")).alias("size"), F.xxhash64("doc_id", "source", "text").alias("shuffle")), "sizes")
    goal = written(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size"))), "targets")
    total = sized.agg(F.sum("size")).first()[0] or 0
    width = min(WIDEST, max(1, total // slots))
    line = ranked(sized, ["source"], ["shuffle", "doc_id", "row"], F.col("size"), "offset")
    g = goal.select(F.col("source").alias("_s"), "source_size", "target")
    line = written(line.join(g, F.col("source").eqNullSafe(F.col("_s"))).drop("_s", "shuffle"), "line")
    plan = written(schedule(goal, -(-total // width), phi), "schedule")
    n = plan.select("source", "n_slots").distinct().select(F.col("source").alias("_s"), "n_slots")
    # the source's words, MOST times end to end, as far as its slots go; rank r takes [r * width, (r + 1) * width)
    laid = line.where("size > 0").join(n, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    laid = laid.withColumn("time", F.explode(F.sequence(F.lit(0), F.lit(MOST - 1)))).withColumn("from", F.col("offset") + F.col("time") * F.col("source_size"))
    laid = laid.withColumn("to", F.least(F.col("from") + F.col("size"), F.col("n_slots") * width)).where(F.col("from") < F.col("to"))
    laid = laid.withColumn("rank", F.explode(F.sequence(F.floor(F.col("from") / width), F.floor((F.col("to") - 1) / width))))
    taken = F.least("to", (F.col("rank") + 1) * width) - F.greatest("from", F.col("rank") * width)
    at = plan.select(F.col("source").alias("_s"), F.col("rank").alias("_r"), "place")
    draws = laid.join(at, F.col("source").eqNullSafe(F.col("_s")) & (F.col("rank") == F.col("_r"))).select("row", "place", taken.alias("words"))
    return line.drop("offset"), draws, width


def applied(docs: DataFrame) -> DataFrame:
    """docs as the mix takes them: a row for each time that a document is taken whole, and at most one with the first words of the last time."""
    row, most, left = (fresh(docs, c) for c in ("_row", "_taken", "_left"))
    kept = written(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    line, draws, _ = mix(kept, row)
    taken = draws.groupBy("row").agg(F.sum("words").alias("taken")).join(line.select("row", "size"), "row")
    # left: the words of each copy of the row, of which only the last may have fewer than all
    each = F.transform(F.sequence(F.lit(1), F.ceil(F.col("taken") / F.col("size")).cast("int")), lambda i: F.least(F.col("size"), F.col("taken") - (i - 1) * F.col("size")))
    taken = taken.select(F.col("row").alias(row), F.col("size").alias(most), F.explode(each).alias(left))
    out = kept.join(taken, row).withColumn("text", F.when(F.col(left) < F.col(most), beginning(F.col("text"), F.col(left))).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def op3_mixing(spark, sf_dir: str) -> DataFrame:
    """The contract's columns: how many words of each document the schedule takes; and first_place, the first slot that takes any."""
    line, draws, _ = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    taken = draws.groupBy("row").agg(F.sum("words").alias("taken"), F.min("place").alias("first_place"))
    return line.join(taken, "row", "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "first_place")


QUERIES, ORACLE = {"op3_mixing": op3_mixing}, {}
