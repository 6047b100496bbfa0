"""Chroma fingerprints of a media column: short recordings are aligned by packed integers.

A recording (16-bit samples at RATE) becomes frames of twelve pitch classes. Filters over an integral image
of the frames, each a difference of two rectangles in log energy, give two bits each; sixteen make a 32-bit
integer for each frame. Recordings whose integers agree in one of KEYS choices of WIDTH bits, at an offset where at least
OVERLAP of the shorter one lies on the other, are candidates; at every such offset (the offset histogram's places that
aren't empty) the share of differing bits is taken, and the least one tells whether they are the same recording.

Bits may differ in every choice of a true copy: README has the recall against all offsets of all pairs.

The test tables have no sound: recordings() renders every row of embeddings as STEPS chords whose notes are
as loud as the vector's components, so that like vectors sound alike.

Queries are the recordings with an id divisible by EVERY, against all. Recordings of equal fingerprints are
one class. Classes of one size are dealt by that of their integers which most classes have, and in blocks; so are
queries. Near copies have it in common, so blocks meet by keys, each key once for a block, and what meets is judged
recording by recording within the task: a group of near copies costs a join's rows for its blocks, not for its pairs.

Defined cases: a null, empty or too short recording has no integers and matches nothing; a null vector has a
null recording; repeated rows are recordings of their own; ties go to the smaller id or offset; an empty
table gives an empty result; only vec_id and embedding are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import key_of, written

#: Samples a second; samples of a frame and between frames; chords and samples of each in a rendered recording.
RATE, FRAME, HOP, STEPS, CHORD = 4000, 512, 128, 24, 256
#: Queries, the share of differing bits up to which recordings match, and the share of the shorter fingerprint that must overlap.
EVERY, ERRORS, OVERLAP = 50, 0.2, 0.5
#: Sixteen filters by rule: kind, first pitch class, pitch classes, frames; the steps of their two bits.
FILTERS = [(i % 4, 5 * i % 9, 2 + i % 2 * 2, 4 + i % 3 * 4) for i in range(16)]
EDGES = (-0.3, 0.0, 0.3)
#: Choices of bits by which candidates are found, and bits of each: the i-th bit of choice k is bit ((2 k + 1) i + 5 k) mod 32.
KEYS, WIDTH = 6, 22
MASKS = [sum({1 << ((2 * k + 1) * i + 5 * k) % 32 for i in range(WIDTH)}) for k in range(KEYS)]
#: Recordings of one length that are rendered or transformed at a time.
AT_ONCE = 32
#: Integers of a block, about: of classes or queries that are met and judged together. No result depends on it.
BLOCK = 4096
#: Instead of an id that there isn't.
NONE = -(1 << 63)


def recordings(vectors: DataFrame) -> DataFrame:
    """(rec_id, audio) of vec_id and embedding."""
    time = np.arange(CHORD) / RATE
    tones = np.sin(2 * np.pi * 440 * 2 ** (np.arange(12)[:, None] / 12) * time)

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[bytes | None] = [None] * batch.num_rows
            same: dict[int, list[tuple[int, list]]] = {}
            for i, v in enumerate(batch.column(1).to_pylist()):
                if v:
                    same.setdefault(len(v), []).append((i, [0.0 if c is None else c for c in v]))
            for size, every in same.items():
                for at in range(0, len(every), AT_ONCE):
                    held = every[at : at + AT_ONCE]
                    x = np.abs(np.nan_to_num(np.array([v for _, v in held]), posinf=0.0, neginf=0.0))
                    loud = x[:, (7 * np.arange(STEPS)[:, None] + 5 * np.arange(12)) % size]
                    sound = (loud @ tones).reshape(len(held), -1)
                    sound = (sound / np.maximum(np.abs(sound).max(1, keepdims=True), 1e-9) * 30000).astype("<i2")
                    for (i, _), s in zip(held, sound, strict=True):
                        out[i] = s.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["rec_id", "audio"])

    return vectors.select("vec_id", F.col("embedding").cast("array<double>")).mapInArrow(render, "rec_id long, audio binary")


def fingerprint(audio: bytes | None) -> list[int]:
    """One signed 32-bit integer for each frame that the widest filter fits behind."""
    sound = np.frombuffer((audio or b"")[: len(audio or b"") // 2 * 2], "<i2")
    return integers(sound[None])[0].tolist()


def integers(sound: np.ndarray) -> np.ndarray:
    """The integers of recordings of one length, a row of each."""
    count = (sound.shape[1] - FRAME) // HOP + 1
    widest = max(f[3] for f in FILTERS)
    if count < widest:
        return np.empty((len(sound), 0), np.int32)
    frames = np.lib.stride_tricks.sliding_window_view(sound.astype(float), FRAME, axis=1)[:, ::HOP] * np.hanning(FRAME)
    power = np.abs(np.fft.rfft(frames)) ** 2
    hertz = np.fft.rfftfreq(FRAME, 1 / RATE)
    heard = (hertz > 100) & (hertz < 1900)
    pitch = np.round(12 * np.log2(hertz[heard] / 440)).astype(int) % 12
    chroma = power[:, :, heard] @ np.eye(12)[pitch]
    chroma /= np.maximum(np.linalg.norm(chroma, axis=2, keepdims=True), 1e-9)
    whole = np.zeros((len(sound), count + 1, 13))
    whole[:, 1:, 1:] = chroma.cumsum(1).cumsum(2)
    at = np.arange(count - widest + 1)

    def area(t: np.ndarray, frames: int, low: int, classes: int) -> np.ndarray:
        return whole[:, t + frames, low + classes] - whole[:, t, low + classes] - whole[:, t + frames, low] + whole[:, t, low]

    out = np.zeros((len(sound), len(at)), np.uint32)
    for kind, low, classes, width in FILTERS:
        half = width // 2
        if kind == 0:  # later against earlier
            a, b = area(at + half, half, low, classes), area(at, half, low, classes)
        elif kind == 1:  # upper against lower pitch classes
            a, b = area(at, width, low + classes // 2, classes - classes // 2), area(at, width, low, classes // 2)
        elif kind == 2:  # crosswise
            a = area(at, half, low, classes // 2) + area(at + half, half, low + classes // 2, classes - classes // 2)
            b = area(at + half, half, low, classes // 2) + area(at, half, low + classes // 2, classes - classes // 2)
        else:  # inside against around
            a = 2 * area(at + width // 4, half, low, classes)
            b = 2 * (area(at, width, low, classes) - area(at + width // 4, half, low, classes))
        level = np.digitize(np.log(np.maximum(a, 0) + 0.1) - np.log(np.maximum(b, 0) + 0.1), EDGES)
        out = (out << np.uint32(2)) | (level ^ (level >> 1)).astype(np.uint32)  # neighbouring levels differ in one bit
    return out.view(np.int32)


def fingerprints(recordings: DataFrame) -> DataFrame:
    """(rec_id, fp array<int>)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[np.ndarray] = [np.empty(0, np.int32)] * batch.num_rows
            same: dict[int, list[tuple[int, np.ndarray]]] = {}
            for i, audio in enumerate(batch.column(1).to_pylist()):
                sound = np.frombuffer((audio or b"")[: len(audio or b"") // 2 * 2], "<i2")
                same.setdefault(len(sound), []).append((i, sound))
            for held in same.values():
                for at in range(0, len(held), AT_ONCE):
                    part = held[at : at + AT_ONCE]
                    for (i, _), x in zip(part, integers(np.stack([s for _, s in part])), strict=True):
                        out[i] = x
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.int32()))], ["rec_id", "fp"])

    return recordings.select("rec_id", "audio").mapInArrow(scan, "rec_id long, fp array<int>")


def postings(blocks: DataFrame) -> DataFrame:
    """(block, size, part, bits, at): the integers of a block at each frame with all but the bits of a choice cleared, each once."""

    def packed(mask: int) -> Column:  # frame and bits in a long, so that equal ones are found by hash
        own = lambda h, i: F.shiftleft(i.cast("long"), 32).bitwiseOR(h.cast("long").bitwiseAND(mask))
        return F.array_distinct(F.flatten(F.transform("members.fp", lambda fp: F.transform(fp, own))))

    parts = blocks.select("block", "size", F.posexplode(F.array(*[packed(m) for m in MASKS])).alias("part", "packed"))
    return parts.select("block", "size", "part", F.explode("packed").alias("p")).select("block", "size", "part", F.col("p").bitwiseAND(0xFFFFFFFF).alias("bits"), F.shiftright("p", 32).cast("int").alias("at"))


def dealt(rows: DataFrame, name: str) -> DataFrame:
    """(block, size, members): the structs `m` of rows with one size and lead, about BLOCK integers at a time."""
    hot = rows.groupBy("size", "lead").agg(F.count("*").alias("n")).select("size", "lead", F.ceil(F.col("n") * F.col("size") / BLOCK).alias("parts")).where("parts > 1")
    split = rows.join(hot, ["size", "lead"], "left").withColumn("split", F.pmod(F.xxhash64("m.id"), F.coalesce("parts", F.lit(1))))
    blocks = split.groupBy("size", "lead", "split").agg(F.collect_list("m").alias("members"))
    return written(blocks.select(F.monotonically_increasing_id().alias("block"), "size", "members"), name)


def leads(classes: DataFrame) -> DataFrame:
    """(class, lead): of the class's integers in the first choice of bits the one that most classes have."""
    own = classes.select("class", F.explode(F.array_distinct(F.transform("fp", lambda h: h.cast("long").bitwiseAND(MASKS[0])))).alias("bits"))
    common = own.join(own.groupBy("bits").agg(F.count("*").alias("n")), "bits")
    return common.groupBy("class").agg(F.max(F.struct("n", F.xxhash64("bits"), "bits")).alias("most")).select("class", F.col("most.bits").alias("lead"))


def judged(pairs: DataFrame) -> DataFrame:
    """(query_id, matches, errors, other, offset): of every query in a block the matches in another block, and the best of them."""
    masks = np.array(MASKS, np.uint32)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, size = [], 0
            row = {name: batch.column(name) for name in batch.schema.names}
            for i in range(batch.num_rows):
                held.append({name: column[i] for name, column in row.items()})
                size += len(held[-1]["fps"].values) + len(held[-1]["queries"].values)
                if size > AT_ONCE * BLOCK:
                    yield found(held)
                    held, size = [], 0
            if held:
                yield found(held)

    def found(rows: list[dict]) -> pa.RecordBatch:
        flat = {name: [r[name].values for r in rows] for name in ("ids", "owns", "queries", "classes", "n", "first", "second", "fps")}
        ids, n, first, second = (np.concatenate([x.to_numpy(zero_copy_only=False) for x in flat[name]]) for name in ("ids", "n", "first", "second"))
        owns, classes = (np.array([v for x in flat[name] for v in x.to_pylist()], object) for name in ("owns", "classes"))
        meet: dict[tuple[int, int, int], list[tuple[np.ndarray, np.ndarray]]] = {}
        q_ints, c_ints = (np.concatenate([x.to_numpy(zero_copy_only=False) for x in flat[name]]).view(np.uint32) for name in ("queries", "fps"))
        q_starts, c_starts = (np.concatenate([[0], np.repeat([r[size].as_py() for r in rows], [len(x) for x in flat[of]]).cumsum()]) for size, of in (("q_size", "ids"), ("size", "n")))
        q_at = c_at = 0
        for r, own, other in zip(rows, flat["ids"], flat["n"], strict=True):
            q, c = np.arange(q_at, q_at + len(own)), np.arange(c_at, c_at + len(other))
            q_at, c_at = q_at + len(own), c_at + len(other)
            both = np.repeat(q, len(c)), np.tile(c, len(q))
            for offset in r["offsets"].as_py():
                meet.setdefault((r["q_size"].as_py(), r["size"].as_py(), offset), []).append(both)
        hits = []
        for (q_size, size, offset), some in meet.items():
            low, high = max(0, -offset), min(q_size, size - offset)
            along = np.arange(low, high)
            q, c = (np.concatenate(x) for x in zip(*some, strict=True))
            step = max(1, (1 << 18) // (high - low))
            for at in range(0, len(q), step):
                a, b = q[at : at + step], c[at : at + step]
                x = q_ints[q_starts[a][:, None] + along] ^ c_ints[c_starts[b][:, None] + along + offset]
                met = np.zeros(x.shape, bool)
                for m in masks:
                    met |= (x & m) == 0
                met = met.any(1)
                a, b, x = a[met], b[met], x[met]
                errors = np.bitwise_count(x).sum(1) / ((high - low) * 32.0)
                met = (errors <= ERRORS) & ((owns[a] != classes[b]) | (n[b] > 1))
                hits.append((a[met], b[met], errors[met], np.full(met.sum(), offset)))
        q, c, errors, offset = (np.concatenate(x) for x in zip(*hits, strict=True))
        # the best offset of each pair, then the best pair of each query
        order = np.lexsort((offset, errors, c, q))
        order = order[np.append(True, np.diff(q[order]).astype(bool) | np.diff(c[order]).astype(bool))[: len(order)]]
        q, c, errors, offset = q[order], c[order], errors[order], offset[order]
        others = n[c] - (owns[q] == classes[c])
        other = np.where(first[c] == ids[q], second[c], first[c])
        order = np.lexsort((offset, other, errors, q))
        begins = np.flatnonzero(np.append(True, np.diff(q[order]).astype(bool))[: len(order)])
        best = order[begins]
        matches = np.add.reduceat(others[order].astype(np.int64), begins) if len(begins) else np.empty(0, np.int64)
        return pa.RecordBatch.from_arrays([pa.array(ids[q[best]], pa.int64()), pa.array(matches, pa.int64()), pa.array(errors[best], pa.float64()), pa.array(other[best].astype(np.int64), pa.int64()), pa.array(offset[best].astype(np.int32), pa.int32())], ["query_id", "matches", "errors", "other", "offset"])

    return pairs.mapInArrow(judge, "query_id long, matches long, errors double, other long, offset int")


def aligned(fps: DataFrame, every: int = EVERY) -> DataFrame:
    """(query_id, matches, best_id, best_offset, best_errors): for each query how many other recordings match, and the best."""
    fps = written(fps.where("rec_id IS NOT NULL").withColumn("class", key_of(F.concat_ws(",", F.col("fp").cast("array<string>")))), "fps")
    least = fps.groupBy("class").agg(F.min("rec_id").alias("first"), F.count("*").alias("n"), F.first("fp").alias("fp"))
    second = fps.join(least.select("class", "first"), "class").where("rec_id > first").groupBy("class").agg(F.min("rec_id").alias("second"))
    classes = written(least.join(second, "class", "left").withColumn("size", F.size("fp")).where("size > 0"), "classes")
    asked = written(fps.where(F.col("rec_id") % every == 0).dropDuplicates(["rec_id"]).select(F.col("rec_id").alias("query_id"), "class", F.col("fp")), "asked")
    lead = written(leads(classes), "leads")
    index = dealt(classes.join(lead, "class").select("size", "lead", F.struct(F.col("class").alias("id"), "n", "first", F.coalesce("second", F.lit(NONE)).alias("second"), "fp").alias("m")), "index")
    wanted = dealt(asked.join(lead, "class").select(F.size("fp").alias("size"), "lead", F.struct(F.col("query_id").alias("id"), F.col("class").alias("own"), "fp").alias("m")), "wanted")
    low, high = F.greatest(F.lit(0), -F.col("offset")), F.least(F.col("q_size"), F.col("size") - F.col("offset"))
    hits = postings(wanted).withColumnsRenamed({"block": "q_block", "size": "q_size", "at": "q_at"}).join(postings(index), ["part", "bits"])
    hits = hits.withColumn("offset", F.col("at") - F.col("q_at")).where(high - low >= F.least("q_size", "size") * OVERLAP)
    pairs = hits.groupBy("q_block", "block").agg(F.collect_set("offset").alias("offsets"))
    q, c = lambda name: F.col(f"w.members.{name}"), lambda name: F.col(f"i.members.{name}")
    pairs = pairs.join(wanted.alias("w"), F.col("q_block") == F.col("w.block")).join(index.alias("i"), pairs["block"] == F.col("i.block")).select(
        F.col("w.size").alias("q_size"), F.col("i.size").alias("size"), "offsets", q("id").alias("ids"), q("own").alias("owns"), F.flatten(q("fp")).alias("queries"),
        c("id").alias("classes"), c("n").alias("n"), c("first").alias("first"), c("second").alias("second"), F.flatten(c("fp")).alias("fps"),
    )
    per = judged(pairs).groupBy("query_id").agg(F.sum("matches").alias("matches"), F.min(F.struct("errors", "other", "offset")).alias("best"))
    best = F.when(F.col("best.other") != NONE, F.col("best.other"))
    return asked.select("query_id").join(per, "query_id", "left").select("query_id", F.coalesce("matches", F.lit(0)).cast("long").alias("matches"), best.alias("best_id"), F.col("best.offset").alias("best_offset"), F.round("best.errors", 6).alias("best_errors"))


def op9_chroma(spark, sf_dir: str) -> DataFrame:
    return aligned(fingerprints(recordings(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))))


QUERIES, ORACLE = {"op9_chroma": op9_chroma}, {}
