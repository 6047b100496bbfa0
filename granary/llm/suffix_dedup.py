"""Suffix-array dedup: removes every byte that a string of `least` bytes occurring elsewhere covers.

The construction is column-wise and over many documents at a time: each round puts one more symbol in
front of every document, and from the symbols and the last round's order makes the new order of suffixes
(the Burrows-Wheeler transform of the column) and the common prefixes of neighbours, reading and writing
both from first to last. A neighbour with `least` bytes in common means a repeat.

Run over whole documents this needs as many rounds as the longest document has bytes, each over everything.
So the collection that is built holds windows instead, all of the same length and aligned:

1. Anchors: of each `least` bytes the K-byte string with the smallest hash. Equal strings of `least` bytes
   hold the same anchor at the same place, so only anchors that occur twice matter.
2. Windows: the bytes around such an anchor, as far as a string of `least` bytes over it can reach.
3. Windows are dealt by anchor, read as sequential runs, and built column by column, 2 * least - K rounds.
4. A window's repeats make one run; runs of a document are merged and cut out.

Equal documents are one document in between. An anchor with over HOT windows is dealt by more bytes: each
window goes to two narrower spans of starts, keyed by the bytes that all strings of the span share, again
and again; a span of a single start needs no construction, since its windows are equal there. So no task
gets more than HOT windows of one key.

Defined cases: a null text is empty; documents under `least` bytes lose nothing; a document that occurs
twice is removed whole if it has `least` bytes; an empty table gives an empty result; only doc_id and text
are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import key_of, texts, written

#: The contract's length; bytes of an anchor.
LEAST, K = 400, 32
#: Windows of one key that a task takes, and that it builds at a time with those of other keys.
HOT, BATCH = 4096, 16384
#: Positions searched at a time: a bound for memory, the blocks overlap.
STEP = 1 << 20
#: No byte: fills up windows at the ends of documents, and equals nothing.
PAD = 256


def anchors(data: np.ndarray, least: int = LEAST, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the anchors: in every `least` bytes the k-byte string of the smallest hash, the first of several."""
    places, hashes = [], []
    width = least - k + 1
    for at in range(0, max(len(data) - least + 1, 0), STEP):
        h = data[at : at + STEP + least - 1].astype(np.uint64) + np.uint64(1)
        size, power = 1, 0x9E3779B97F4A7C15
        while size < k:  # hashes of strings twice as long
            h = h[:-size] * np.uint64(power) + h[size:]
            size, power = size * 2, power * power & (1 << 64) - 1
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
        # the smallest of `width` in a row, its place in the low bits: leftmost of equal ones
        low = (h & np.uint64(-1 << 21 & (1 << 64) - 1)) | np.arange(len(h), dtype=np.uint64)
        size = 1
        while size * 2 <= width:
            low = np.minimum(low[:-size], low[size:])
            size *= 2
        if size < width:
            low = np.minimum(low[: len(low) - (width - size)], low[width - size :])
        first = low[np.append(True, low[1:] != low[:-1])] & np.uint64((1 << 21) - 1)
        own = first.astype(np.int64)
        places.append(own + at)
        hashes.append(h[own])
    if not places:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    place, first = np.unique(np.concatenate(places), return_index=True)
    return place, np.concatenate(hashes)[first].view(np.int64)


def repeats(columns: np.ndarray, starts: int, least: int) -> np.ndarray:
    """columns[j, i]: byte j of window i. Whether the string of `least` bytes from byte j < starts is in another window at j.

    Rounds go from the last column to the first; order and common prefixes are those of the last round."""
    length, m = columns.shape
    found = np.zeros((starts, m), bool)
    order, common = np.arange(m), np.zeros(m + 1, np.int32)  # common[i]: of the suffixes at i - 1 and i in the order
    for j in range(length - 1, -1, -1):
        symbols = columns[j][order]  # this column of the transform
        by = np.argsort(symbols, kind="stable")
        s = symbols[by]
        new = np.zeros(m + 1, np.int32)
        if m > 1:
            same = np.flatnonzero((s[1:] == s[:-1]) & (s[1:] != PAD))
            # neighbours now were at by[i] and by[i + 1]: they share the least of what lies between
            spans = np.stack([by[same] + 1, by[same + 1] + 1], 1).ravel()
            if len(spans):
                new[same + 1] = np.minimum.reduceat(common, spans)[::2] + 1
        order, common = order[by], new
        if j < starts:
            found[j, order] = np.maximum(common[:-1], common[1:]) >= least
    return found


def windows(data: np.ndarray, places: np.ndarray, least: int, k: int) -> np.ndarray:
    """Row i: the bytes from places[i] - (least - k) to places[i] + least, PAD outside."""
    at = places[:, None] + np.arange(k - least, least)
    inside = (at >= 0) & (at < len(data))
    return np.where(inside, data[np.clip(at, 0, len(data) - 1)].astype(np.uint16), np.uint16(PAD))


class Dedup:
    def __init__(self, docs: DataFrame, least: int = LEAST, k: int = K):
        self.docs, self.least, self.k = texts(docs).withColumn("data", F.encode("text", "UTF-8")).drop("text"), least, k

    def twice(self) -> DataFrame:
        """(key, hash): the anchors of each distinct document that occur twice."""
        least, k = self.least, self.k

        def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                of, hashes, counts = [], [], []
                for i, data in enumerate(batch.column(1).to_pylist()):
                    h, n = np.unique(anchors(np.frombuffer(data, np.uint8), least, k)[1], return_counts=True)
                    of.append(np.full(len(h), i))
                    hashes.append(h)
                    counts.append(np.minimum(n, 2))
                whole = [np.concatenate(x) if x else np.empty(0, np.int64) for x in (of, hashes, counts)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(whole[0])), pa.array(whole[1]), pa.array(whole[2])], ["key", "hash", "n"])

        each = self.docs.where(F.length("data") >= least).select(key_of("data").alias("key"), "data")
        each = written(each.mapInArrow(find, "key binary, hash long, n long"), "anchors")
        # equal documents count once, so (key, hash) pairs are made distinct first
        each = each.dropDuplicates(["key", "hash"])
        held = each.groupBy("hash").agg(F.sum("n").alias("all")).where("all > 1").select("hash")
        return each.join(held, "hash", "left_semi").select("key", "hash")

    def runs(self, docs: DataFrame) -> DataFrame:
        """(key, places, start, end): what repeats around the anchors at those places, relative to them. docs: (key, data, hashes)."""
        least, k = self.least, self.k

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                of, hashes, held, at = [], [], [], []
                for i, (data, known) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                    data = np.frombuffer(data, np.uint8)
                    places, h = anchors(data, least, k)
                    kept = np.isin(h, np.array(known, np.int64))
                    places, h = places[kept], h[kept]
                    same: dict[tuple[int, bytes], list[int]] = {}
                    for a in range(0, len(places), 1024):
                        for p, x, w in zip(places[a : a + 1024].tolist(), h[a : a + 1024].tolist(), windows(data, places[a : a + 1024], least, k), strict=True):
                            same.setdefault((x, w.tobytes()), []).append(p)
                    for (x, w), p in same.items():
                        of.append(i)
                        hashes.append(x)
                        held.append(w)
                        at.append(p)
                    if len(held) > 4096:
                        yield rows(batch, of, hashes, held, at)
                        of, hashes, held, at = [], [], [], []
                yield rows(batch, of, hashes, held, at)

        def rows(batch: pa.RecordBatch, of: list, hashes: list, held: list, at: list) -> pa.RecordBatch:
            # a byte is enough but for PAD, whose places are before or after the document's own
            arrays = [np.frombuffer(w, np.uint16) for w in held]
            raw = [w.astype(np.uint8).tobytes() for w in arrays]
            first = [int((w[: len(w) // 2] == PAD).sum()) for w in arrays]
            last = [len(w) - int((w[len(w) // 2 :] == PAD).sum()) for w in arrays]
            return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of, pa.int64())), pa.array(hashes, pa.int64()), pa.array(raw, pa.binary()), pa.array(first, pa.int32()), pa.array(last, pa.int32()), pa.array(at, pa.list_(pa.int32()))], ["key", "hash", "window", "first", "last", "places"])

        cuts = written(docs.mapInArrow(cut, "key binary, hash long, window binary, first int, last int, places array<int>"), "windows")
        full = least - k
        start, end = F.greatest("lo", "first"), F.least("hi", F.col("last") - least) + least  # all starts of a span inside the document
        whole = lambda df: df.where(start + least <= end).select("key", "places", start.alias("start"), end.alias("end"))
        # span [lo, hi] of starts; all strings from these starts that can be equal are in one bucket
        left = cuts.withColumn("lo", F.lit(0)).withColumn("hi", F.lit(full)).withColumn("bucket", F.col("hash"))
        out = [whole(left.where(F.size("places") > 1))]  # equal windows in one document
        while True:
            counts = written(left.groupBy("bucket", "lo").count().where("count > 1"), "counts")
            out.append(self.built(left.join(counts.where(F.col("count") <= HOT), ["bucket", "lo"], "left_semi")))
            hot = counts.where(F.col("count") > HOT)
            if hot.isEmpty():
                break
            # windows that are equal over the whole span: all repeat, and one of them stands for the others
            span = F.expr(f"substring(window, lo + 1, hi - lo + {least})")
            rest = left.join(hot.select("bucket", "lo"), ["bucket", "lo"], "left_semi").withColumn("same", F.sha2(F.concat(span, F.encode(F.concat_ws(",", F.greatest("lo", "first"), F.least(F.col("hi") + least, F.col("last"))), "UTF-8")), 256))
            rest = written(rest, "hot")
            equal = written(rest.groupBy("bucket", "lo", "same").count().where("count > 1"), "equal")
            out.append(whole(rest.join(equal, ["bucket", "lo", "same"], "left_semi")))
            rest = written(rest.dropDuplicates(["bucket", "lo", "same"]).drop("same"), "rest")
            still = rest.groupBy("bucket", "lo").count().where(F.col("count") > HOT).select("bucket", "lo")
            middle = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
            halves = F.array(F.struct(F.col("lo").alias("lo"), middle.alias("hi")), F.struct((middle + 1).alias("lo"), F.col("hi").alias("hi")))
            split = rest.join(still, ["bucket", "lo"], "left_semi").where("lo < hi").withColumn("half", F.explode(halves)).withColumn("lo", F.col("half.lo")).withColumn("hi", F.col("half.hi")).drop("half")
            shared = F.expr(f"substring(window, hi + 1, lo + {least} - hi)")
            split = split.where(f"first <= hi AND last >= lo + {least}").withColumn("bucket", F.xxhash64("hash", "lo", shared))
            left = written(rest.join(still, ["bucket", "lo"], "left_anti").select(*left.columns).unionAll(split.select(*left.columns)), "left")
        found = out[0]
        for more in out[1:]:
            found = found.unionAll(more)
        return found

    def built(self, rows: DataFrame) -> DataFrame:
        least, k = self.least, self.k

        def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, size = [], 0
            for batch in batches:
                while batch.num_rows:
                    if size < BATCH:
                        part = batch.slice(0, BATCH - size)
                        batch = batch.slice(part.num_rows)
                    else:  # go on to the end of the bucket that has begun
                        bucket = held[-1].column("bucket")[-1].as_py()
                        own = batch.column("bucket").to_numpy() == bucket
                        n = len(own) if own.all() else int(np.argmin(own))
                        part, batch = batch.slice(0, n), batch.slice(n)
                        if not n:
                            yield result(held)
                            held, size = [], 0
                            continue
                    held.append(part)
                    size += part.num_rows
            if held:
                yield result(held)

        def result(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            batch = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            m, starts = batch.num_rows, least - k + 1
            first, last, lo, hi = (batch.column(c).to_numpy() for c in ("first", "last", "lo", "hi"))
            block = np.frombuffer(b"".join(batch.column("window").to_pylist()), np.uint8).reshape(m, 2 * least - k).astype(np.uint16)
            j = np.arange(2 * least - k)
            block[(j < first[:, None]) | (j >= last[:, None])] = PAD
            found = np.zeros((starts, m), bool)
            for span in np.unique(lo):  # a window is in one bucket of each span, and must not meet itself
                own = np.flatnonzero(lo == span)
                found[:, own] = repeats(np.ascontiguousarray(block[own].T), starts, least)
            start = np.arange(starts)[:, None]
            found &= (start >= lo) & (start <= hi)
            begin, end = found.argmax(0), starts - 1 - found[::-1].argmax(0) + least
            out = pa.RecordBatch.from_arrays([batch.column("key"), batch.column("places"), pa.array(begin.astype(np.int32)), pa.array(end.astype(np.int32))], ["key", "places", "start", "end"])
            return out.filter(pa.array(found.any(0)))

        dealt = rows.repartition("bucket").sortWithinPartitions("lo", "bucket")
        return dealt.select("key", "bucket", "window", "first", "last", "places", "lo", "hi").mapInArrow(build, "key binary, places array<int>, start int, end int")

    def run(self) -> DataFrame:
        """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, removed: array<struct<start,end>>)."""
        least, k = self.least, self.k
        rows = written(self.docs.select("doc_id", key_of("data").alias("key"), F.length("data").cast("int").alias("size")), "rows")
        copies = rows.groupBy("key").agg(F.count("*").alias("copies"), F.min("doc_id").alias("of"), F.first("size").alias("size"))
        hashes = self.twice().groupBy("key").agg(F.collect_list("hash").alias("hashes"))  # no more than the document has
        wanted = written(hashes.join(copies, "key").select("of", "key", "hashes"), "wanted")
        data = self.docs.join(wanted.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("of"))).where(key_of("data") == F.col("key")).select("key", "data", "hashes")
        if not rows.groupBy("doc_id", "key").count().where("count > 1").isEmpty():  # rows that are the same in both
            data = data.dropDuplicates(["key"])
        found = self.runs(data)
        before = F.col("at") - (least - k)
        spans = found.select("key", F.explode("places").alias("at"), "start", "end").select("key", F.struct((before + F.col("start")).alias("start"), (before + F.col("end")).alias("end")).alias("span"))
        spans = spans.groupBy("key").agg(F.array_sort(F.collect_list("span")).alias("spans"))
        whole = F.when((F.col("copies") > 1) & (F.col("size") >= least), F.array(F.struct(F.lit(0).alias("start"), F.col("size").alias("end"))))
        cuts = copies.join(spans, "key", "left").select("key", F.coalesce(whole, "spans").alias("spans")).where("spans IS NOT NULL")
        out = self.docs.withColumn("key", key_of("data")).join(written(cuts, "cuts"), "key", "left").select("doc_id", "data", "spans")
        return out.mapInArrow(_kept, f"doc_id {self.docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed array<struct<start:int,end:int>>")


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        size, removed, count, sha, merged = [], [], [], [], []
        for data, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            runs: list[list[int]] = []
            for s in spans or []:
                if runs and s["start"] <= runs[-1][1]:
                    runs[-1][1] = max(runs[-1][1], s["end"])
                else:
                    runs.append([s["start"], s["end"]])
            h = hashlib.sha256()
            edges = [0, *(x for r in runs for x in r), len(data)]
            for a, b in zip(edges[::2], edges[1::2], strict=True):
                h.update(data[a:b])
            size.append(len(data))
            removed.append(sum(b - a for a, b in runs))
            count.append(len(runs))
            sha.append(h.hexdigest())
            merged.append([{"start": a, "end": b} for a, b in runs])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(removed, pa.int64()), pa.array(count, pa.int64()), pa.array(sha, pa.string()), pa.array(merged, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed"])


def op2_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return Dedup(spark.read.parquet(f"{sf_dir}/documents.parquet")).run().drop("removed")


QUERIES, ORACLE = {"op2_suffix_dedup": op2_suffix_dedup}, {}
