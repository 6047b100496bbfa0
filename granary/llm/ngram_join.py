"""N-gram Jaccard join by a token-group matrix; its answer is each document's component of linked documents.

A document's set holds its distinct word shingles as 62-bit numbers. Sets of sizes n and m link if they
differ in at most D = (n + m) * (1 - t) / (1 + t) numbers. The range of numbers is cut into more than D parts,
so sets that link have a part in which they agree and which isn't empty: a key, made of several shingles, that
only similar sets share, however frequent each shingle is. (How many parts there are depends on the size, in
levels; a set has keys for each level that it can meet partners on.)

1. Documents are partitioned into groups of similar ones: a set's least numbers in BANDS * EACH ranges, EACH at a
   time, name buckets in which similar sets meet; each set is held against one leader of each of its buckets. What links
   makes groups (any grouping gives the same links in the end), cut into blocks of at most BLOCK sets.
2. The matrix (key, block) is read by every set that shares a key with a block of another group. A block
   stores the union of its sets' tokens, and the tokens that all of them have, as BITS_U bits each: tokens of
   the set outside the union, and common ones that it lacks, bound its overlap with any member from above.
3. Only blocks whose bound reaches the threshold are opened: their members are bounded one by one (parities of
   BITS_P bits differ by no more than the sets), then checked by whole sets. Pairs within a group need no check:
   they are connected already.

No link is lost and nothing is capped or broadcast: the bounds are necessary conditions, the last check is exact
but for equal 62-bit hashes of different shingles, each of which changes a count by one. Sets are told apart by 128 bits.

Defined cases: a null or empty text, or one without words, has an empty set, links with nothing and is its
own component; with fewer words than a shingle the whole sequence is the one shingle; equal sets are one
set; repeated rows each get a row; a null doc_id is a document like any other, and the smallest doc_id of a component
is null only if all are; rows of one doc_id may have different texts; an empty table gives an empty result; only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, forget, texts, written

#: The contract's measure: shingles of N words; a link when DEN * intersection >= NUM * union.
N, NUM, DEN = 4, 85, 100
#: Sets in a block of a group (any number gives the same links).
BLOCK = 64
#: Keys of a set and of a block by which it is told whether they have met already (any number gives the same links).
EARLY = 16
#: Buckets that a set is in when groups are made, and least numbers that name each.
BANDS, EACH = 8, 4
#: Bits of a set's parities, and of the unions.
BITS_P, BITS_U = 512, 256
#: Names of sets that a task remembers, so that copies it meets again send no keys; forgetting them costs rows, no result.
RECENT = 1 << 18

#: ASCII white space, as a table of bytes; the base of the words' polynomial hash.
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_BASE = 0x9E3779B97F4A7C15
_P, _U, _B = [f"p{i}" for i in range(BITS_P // 64)], [f"u{i}" for i in range(BITS_U // 64)], [f"b{i}" for i in range(BANDS)]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def shingles(text: str, n: int = N) -> np.ndarray:
    """Sorted distinct 62-bit numbers of the text's word shingles; bytes split at ASCII white space only."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass").lower(), np.uint8)
    letter = ~_SPACE[data]
    starts = np.flatnonzero(letter & np.append(True, ~letter[:-1])) if len(data) else data
    if not len(starts):
        return np.empty(0, np.int64)
    sizes = np.diff(np.append(starts, len(data)))
    powers = np.multiply.accumulate(np.full(int(sizes.max()), _BASE, np.uint64))
    place = np.arange(starts[0], len(data)) - np.repeat(starts, sizes)
    h = np.add.reduceat((data[starts[0] :].astype(np.uint64) + np.uint64(1)) * letter[starts[0] :] * powers[place], starts - starts[0])
    h = _mixed(h)
    k = min(n, len(h))
    count = len(h) - k + 1
    out = h[:count]
    for j in range(1, k):
        out = _mixed(out) + h[j : count + j]
    return np.unique((_mixed(out + np.uint64(k)) >> np.uint64(2)).astype(np.int64))


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    return int((b[np.minimum(at, len(b) - 1)] == a).sum())


def name(w: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set, as two signed numbers."""
    x = xxhash.xxh3_128_intdigest(w.tobytes())
    return (x >> 64) - (1 << 63), (x & (1 << 64) - 1) - (1 << 63)


def bits(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A set's parities and its tokens, in BITS_P and BITS_U bits, as signed 64-bit numbers."""
    counts = np.bincount((w.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(65 - BITS_P.bit_length())).astype(np.int64), minlength=BITS_P)
    held = counts.reshape(BITS_U, -1).any(1)
    return tuple(np.packbits(x.astype(np.uint8), bitorder="little").view(np.int64) for x in (counts & 1, held))


def bands(w: np.ndarray) -> np.ndarray:
    """The buckets of a sorted set that isn't empty; where a range has no number, the next one's counts."""
    at = np.searchsorted(w, np.arange(BANDS * EACH) * ((1 << 62) // (BANDS * EACH)))
    least = _mixed(w[at % len(w)].astype(np.uint64)).reshape(BANDS, EACH)
    out = np.arange(BANDS, dtype=np.uint64)
    for j in range(EACH):
        out = _mixed(out + np.uint64(1)) + least[:, j]
    return out.view(np.int64)


def wide(w: np.ndarray) -> bytes:
    """A set's parities in at least two bits for each number; half of them, put over the other half, are those of half as many bits."""
    size = max(64, 1 << (2 * len(w) - 1).bit_length())
    counts = np.bincount((_mixed(w.astype(np.uint64)) & np.uint64(size - 1)).astype(np.int64), minlength=size)
    return np.packbits((counts & 1).astype(np.uint8), bitorder="little").tobytes()


def apart(a: bytes, b: bytes) -> int:
    """Numbers in which two sets differ at least, by what wide() gives of them."""
    x, y = (np.frombuffer(v, np.uint64) for v in (a, b))
    if len(x) > len(y):
        x, y = y, x
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


class Parts:
    """Keys of sets such that two sets with den * intersection >= num * union share one at least."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        edge, edges = 1.0, [1]
        while edges[-1] < 1 << 40:
            edge *= (den / num) ** 1.5
            edges.append(max(edges[-1] + 1, int(edge)))
        self.edges = np.array(edges)

    def most(self, level: int) -> int:
        """Numbers in which two sets that link differ at most, the smaller one being of that level."""
        n = int(self.edges[level + 1]) - 1
        return (n + n * self.den // self.num) * (self.den - self.num) // (self.den + self.num)

    def of(self, w: np.ndarray) -> np.ndarray:
        """The keys of a sorted set that isn't empty. Where too few parts hold any number, twice as many parts give further
        keys; two such sets meet there."""
        level = int(np.searchsorted(self.edges, len(w), "right")) - 1
        least = -(-self.num * len(w) // self.den)  # the smallest partner
        out, own = [], _mixed(w.astype(np.uint64))
        while level >= 0:
            most = self.most(level)
            parts, more = most + 1 + (most // 8 + 2 if most else 0), 0
            while True:
                at = ((w >> 22) * parts) >> 40
                first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
                salt = at[first].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(level * 64 + more + 1)
                out.append(_mixed(np.add.reduceat(own, first) ^ _mixed(salt)).view(np.int64))
                if len(first) > most:
                    break
                parts, more = parts * 2, more + 1
            if least >= self.edges[level]:
                break
            level -= 1
        return np.concatenate(out)


class Join:
    """One run over docs: words to a shingle, and the threshold num / den."""

    def __init__(self, docs: DataFrame, n: int = N, num: int = NUM, den: int = DEN):
        self.n, self.num, self.den = n, num, den
        self.docs = texts(docs).withColumn("id", F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("~"), F.md5("text"))))

    def rows(self) -> DataFrame:
        """(doc_id, id, hi, lo, n, keys, parities, tokens, bands): hi and lo name the set, n is its size."""
        n, parts = self.n, Parts(self.num, self.den)

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            recent: set[tuple[int, int]] = set()
            for batch in batches:
                high, low, size, keys, flags = [], [], [], [], []
                for t in batch.column(1).to_pylist():
                    w = shingles(t, n)
                    own = name(w)
                    high.append(own[0])
                    low.append(own[1])
                    size.append(len(w))
                    flags.append(np.concatenate([*bits(w), bands(w) if len(w) else np.zeros(BANDS, np.int64)]))
                    keys.append(parts.of(w) if len(w) and own not in recent else w[:0])
                    recent.add(own)
                if len(recent) > RECENT:
                    recent.clear()
                flags = np.array(flags, np.int64).reshape(len(size), -1)
                ends = np.append(0, np.cumsum([len(k) for k in keys])).astype(np.int32)
                keys = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(keys) if keys else np.empty(0, np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *(pa.array(x, pa.int64()) for x in (high, low, size)), keys, *(pa.array(np.ascontiguousarray(c)) for c in flags.T)], ["doc_id", "id", "hi", "lo", "n", "keys", *_P, *_U, *_B])

        kind = self.docs.schema["doc_id"].dataType.simpleString()
        return self.docs.mapInArrow(scan, f"doc_id {kind}, id string, hi long, lo long, n long, keys array<long>, " + ", ".join(f"{c} long" for c in _P + _U + _B))

    def fits(self, n: Column, low: Column, high: Column) -> Column:
        """Whether a set of n numbers can link with one of low to high."""
        return (n * self.num <= high * self.den) & (low * self.num <= n * self.den)

    def most(self, n: Column, m: Column) -> Column:
        """In how many numbers linked sets of n and m differ at most."""
        return F.floor((n + m) * (self.den - self.num) / F.lit(self.den + self.num) + 1e-6)

    def alike(self, n: str, m: str, one: list[str], two: list[str]) -> Column:
        """By sizes and parities two sets can link."""
        differ = reduce(add, [F.bit_count(F.col(a).bitwiseXOR(F.col(b))) for a, b in zip(one, two, strict=True)])
        return self.fits(F.col(n), F.col(m), F.col(m)) & (differ <= self.most(F.col(n), F.col(m)))

    def whole(self, sets: DataFrame, repeated: bool) -> DataFrame:
        """(sid, w, wide): the whole sets, and their parities."""
        n = self.n

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids, high, low = (batch.column(c).to_pylist() for c in (0, 1, 2))
                made = [shingles(t, n) for t in batch.column(3).to_pylist()]
                own = [i for i, w in enumerate(made) if name(w) == (high[i], low[i])]  # a doc_id may have other texts
                yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in own], pa.int64()), pa.array([made[i] for i in own], pa.list_(pa.int64())), pa.array([wide(made[i]) for i in own], pa.binary())], ["sid", "w", "wide"])

        out = self.docs.join(sets.select("sid", "hi", "lo", "id").hint("shuffle_hash"), "id").select("sid", "hi", "lo", "text").mapInArrow(scan, "sid long, w array<long>, wide binary")
        return written(out.dropDuplicates(["sid"]) if repeated else out, "whole")

    def checked(self, pairs: DataFrame, whole: DataFrame) -> DataFrame:
        """Of the pairs (a, b) of sets those that link: first by parities, a small part of a set's size, then by whole sets."""
        num, den = self.num, self.den

        def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                a, b, n, m, p, q = (batch.column(i).to_pylist() for i in range(6))
                ok = [(num + den) * apart(x, y) <= (den - num) * (i + j) for i, j, x, y in zip(n, m, p, q, strict=True)]
                yield batch.filter(pa.array(ok, pa.bool_())).select(["a", "b"])

        small = lambda s, n, p: whole.select(F.col("sid").alias(s), F.size("w").cast("long").alias(n), F.col("wide").alias(p))
        pairs = pairs.join(small("a", "n", "p"), "a").join(small("b", "m", "q"), "b").select("a", "b", "n", "m", "p", "q")
        pairs = written(pairs.mapInArrow(near, "a long, b long"), "near")

        def arrays(batch: pa.RecordBatch, at: int) -> list[np.ndarray]:
            column = batch.column(at)
            ends, values = column.offsets.to_numpy(), column.values.to_numpy()
            return [values[i:j] for i, j in zip(ends, ends[1:], strict=False)]

        def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ok = [(num + den) * overlap(p, q) >= num * (len(p) + len(q)) for p, q in zip(arrays(batch, 2), arrays(batch, 3), strict=True)]
                yield batch.filter(pa.array(ok, pa.bool_())).select(["a", "b"])

        at_a, at_b = whole.select(F.col("sid").alias("a"), F.col("w").alias("w_a")), whole.select(F.col("sid").alias("b"), F.col("w").alias("w_b"))
        return written(pairs.join(at_a, "a").join(at_b, "b").select("a", "b", "w_a", "w_b").mapInArrow(check, "a long, b long"), "links")

    def led(self, sets: DataFrame) -> DataFrame:
        """Pairs (a, b): each set and the leaders of its buckets, as far as sizes and parities let them link."""
        each = sets.select("sid", F.explode(F.array(*_B)).alias("band"))
        least = each.groupBy("band").agg(F.min("sid").alias("leader"), F.max("sid").alias("last")).where("leader < last").select("band", "leader")
        pairs = each.join(least, "band").where("sid <> leader").select(F.col("sid").alias("a"), F.col("leader").alias("b")).distinct()
        one = sets.select(F.col("sid").alias("a"), "n", *_P)
        two = sets.select(F.col("sid").alias("b"), F.col("n").alias("m"), *[F.col(c).alias(f"o{c}") for c in _P])
        return pairs.join(one, "a").join(two, "b").where(self.alike("n", "m", _P, [f"o{c}" for c in _P])).select("a", "b")

    def opened(self, held: DataFrame, sets: DataFrame, group: DataFrame) -> DataFrame:
        """Pairs (a, b) of sets in different groups that the matrix lets through."""
        of = held.select("key", "hi", "lo").join(sets.select("hi", "lo", "sid"), ["hi", "lo"]).join(group, "sid", "left")
        of = written(of.select("key", "sid", F.coalesce("component", "sid").alias("own")), "grouped")
        apart = of.groupBy("key").agg(F.min("own").alias("low"), F.max("own").alias("high")).where("low <> high").select("key")
        of = written(of.join(apart, "key"), "apart")

        level = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(self.den / self.num))).cast("int")
        members = of.select("sid", "own").distinct().join(sets.select("sid", "n", *_P, *_U), "sid").withColumn("level", level)
        counts = members.groupBy("own", "level").agg(F.count("*").alias("count"))
        sizes = counts.groupBy("own").agg(F.sum("count").alias("size"))
        per = counts.join(sizes, "own").select("own", "level", "size", F.ceil(F.col("count") / BLOCK).alias("blocks"))
        members = members.join(per, ["own", "level"]).withColumn("block", F.xxhash64("own", "level", F.pmod(F.xxhash64("sid"), F.col("blocks"))))
        members = written(members.drop("level", "blocks"), "members")

        unions = [F.bit_or(c).alias(f"any_{c}") for c in _U] + [F.bit_and(c).alias(f"all_{c}") for c in _U]
        blocks = members.groupBy("block").agg(F.count("*").alias("sets"), F.min("n").alias("low"), F.max("n").alias("high"), F.first("own").alias("other"), F.first("size").alias("others"), *unions, *[F.first(c).alias(f"o{c}") for c in _P])
        # a set meets a block at the first key they share, or at more if that isn't among the first EARLY of both
        least = F.slice(F.array_sort(F.collect_set("key")), 1, EARLY)  # a set's keys, no more than it has numbers
        keyed = written(of.join(members.select("sid", "block"), "sid").select("key", "block").distinct(), "keyed")
        matrix = keyed.join(blocks, "block").join(keyed.groupBy("block").agg(least.alias("early")), "block")
        query = of.select("key", "sid").join(members.drop("block"), "sid").join(of.groupBy("sid").agg(least.alias("before")), "sid")
        query = query.withColumn("before", F.filter("before", lambda x: x < F.col("key")))
        apart = (F.col("size") < F.col("others")) | ((F.col("size") == F.col("others")) & (F.col("own") < F.col("other")))
        most = self.most(F.col("n"), F.least("high", F.floor(F.col("n") * self.den / F.lit(self.num))))
        outside = [F.bit_count(F.col(c).bitwiseAND(F.bitwise_not(f"any_{c}"))) for c in _U] + [F.bit_count(F.col(f"all_{c}").bitwiseAND(F.bitwise_not(c))) for c in _U]
        bound = self.fits(F.col("n"), F.col("low"), F.col("high")) & (reduce(add, outside) <= most) & ((F.col("sets") > 1) | self.alike("n", "low", _P, [f"o{c}" for c in _P]))
        hits = query.join(matrix, "key").where(apart & bound & ~F.arrays_overlap("before", "early")).select(F.col("sid").alias("a"), "block").distinct()

        one = members.select(F.col("sid").alias("a"), "n", *_P)
        two = members.select("block", F.col("sid").alias("b"), F.col("n").alias("m"), *[F.col(c).alias(f"o{c}") for c in _P])
        return hits.join(one, "a").join(two, "block").where(self.alike("n", "m", _P, [f"o{c}" for c in _P])).select("a", "b")

    def run(self) -> DataFrame:
        """(doc_id, n_shingles, component_id) of every row."""
        rows = written(self.rows(), "keys")
        keys = rows.where("size(keys) > 0").select(F.explode("keys").alias("key"), "hi", "lo")
        # different sets of one key differ in lo; that two of the few that meet there do not has a chance of 2^-64
        shared = written(keys.groupBy("key").agg(F.min("lo").alias("first"), F.max("lo").alias("last")).where("first <> last").select("key"), "shared")
        every = written(keys.join(shared, "key"), "held")
        held = written(every.distinct(), "held")
        with_keys, rows = rows, written(rows.drop("keys"), "rows")
        for done in (with_keys, shared, every):
            forget(done)
        every = rows.where("n > 0").groupBy("hi", "lo").agg(F.min("id").alias("id"), *[F.first(c).alias(c) for c in ("n", *_P, *_U, *_B)])
        sets = written(every.join(held.select("hi", "lo").distinct(), ["hi", "lo"]).withColumn("sid", F.monotonically_increasing_id()), "sets")
        repeated = not rows.groupBy("id", "hi", "lo").count().where("count > 1").isEmpty()
        whole = self.whole(sets, repeated)

        links = self.checked(self.led(sets), whole)
        group = written(components(links).withColumnRenamed("node", "sid"), "groups")
        more = self.checked(self.opened(held, sets, group), whole)
        if not more.isEmpty():
            group = written(components(links.unionAll(more)).withColumnRenamed("node", "sid"), "groups")

        known = sets.select("sid", "hi", "lo").join(group, "sid").select("hi", "lo", "component")
        named = rows.where("n > 0").select("doc_id", "n", "hi", "lo").join(known, ["hi", "lo"], "left")
        linked = F.col("component").isNotNull()
        named = written(named.select("doc_id", "n", *[F.when(linked, 0).otherwise(F.col(c)).alias(c) for c in ("hi", "lo")], F.coalesce("component", F.lit(-1)).alias("of")), "named")
        least = written(named.groupBy("of", "hi", "lo").agg(F.min("doc_id").alias("component_id")), "least")
        out = named.join(least, ["of", "hi", "lo"]).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
        return out.unionAll(rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def op8_ngram_join(spark, sf_dir: str) -> DataFrame:
    return Join(spark.read.parquet(f"{sf_dir}/documents.parquet")).run()


QUERIES, ORACLE = {"op8_ngram_join": op8_ngram_join}, {}
