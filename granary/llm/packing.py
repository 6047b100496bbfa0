"""Best-fit packing planned on the histogram of lengths.

Documents are cut into pieces of `width` tokens; the first piece may be shorter. The plan is made on the histogram (at most `width`
counts): best fit in order of decreasing length, where sequences that look alike are handled as one run.
Pieces then take the planned places by joining on their rank within their length.

Token ids are those of the tokenizers file; a faster library reads the same vocabulary, and a test holds
both against each other.

Defined cases: a null text is empty and gives one piece of one token, the end mark; repeated rows are
documents of their own; an empty table gives an empty result; columns other than doc_id and text aren't read.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ranked, texts, written

#: Fixed values of the contract: tokens in a sequence, the id that ends a document.
WIDTH, END = 1024, 2
#: The special token's text and id in this vocabulary.
SPECIAL = ("<|endoftext|>", 50256)
_encoding = {}


def encoder(path: str, pattern: str):
    """A function text -> list of ids, made once in each Python worker."""
    if path not in _encoding:
        import base64

        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        e = tiktoken.Encoding("vocabulary", pat_str=pattern, mergeable_ranks=ranks, special_tokens=dict([SPECIAL]))
        _encoding[path] = lambda t: e.encode(t, allowed_special="all") if SPECIAL[0] in t else e.encode_ordinary(t)
    return _encoding[path]


def pieces(docs: DataFrame, path: str | None = None, width: int = WIDTH) -> DataFrame:
    """(doc_id, piece, start, length, ids): ids is the piece's token ids as little-endian 32-bit integers."""
    import public_tokenizers

    path, pattern = path or public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path, pattern)
        for batch in batches:
            of, piece, start, length, held = [], [], [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                ids = encode(text)
                ids.append(END)
                raw = np.array(ids, dtype="<u4").tobytes()
                first = (len(ids) - 1) % width + 1
                for k, end in enumerate(range(first, len(ids) + 1, width)):
                    at = max(0, end - width)
                    of.append(i)
                    piece.append(k)
                    start.append(at)
                    length.append(end - at)
                    held.append(raw[4 * at : 4 * end])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(held, pa.binary())], ["doc_id", "piece", "start", "length", "ids"])

    return texts(docs).mapInArrow(cut, f"doc_id {id_type}, piece int, start long, length long, ids binary")


def plan(histogram: dict[int, int], width: int = WIDTH) -> list[tuple[int, int, int, int, int, int]]:
    """Runs (length, first rank, ranks, first sequence, ranks to a sequence, offset of the first of them).

    free maps the room left to runs of sequences (first, count). Each step puts pieces of one length into a
    run of equally full sequences, as many to each as fit: what best fit does to them one after another."""
    runs, free, room, sequences = [], {}, [], 0

    def add(left: int, first: int, count: int) -> None:
        if count and left:
            if left not in free:
                free[left] = []
                bisect.insort(room, left)
            free[left].append((first, count))

    for length in sorted(histogram, reverse=True):
        rank, n = 0, histogram[length]
        while n:
            at = bisect.bisect_left(room, length)
            if at < len(room):
                left = room[at]
                first, count = free[left].pop()
                if not free[left]:
                    del free[left], room[at]
            else:
                left, first = width, sequences
                count = -(-n // (width // length))
                sequences += count
            each = left // length
            full = min(count, n // each)
            if full:
                runs.append((length, rank, full * each, first, each, width - left))
                add(left - each * length, first, full)
                rank, n = rank + full * each, n - full * each
            if full < count and n:  # fewer than `each` are left: one more sequence takes them
                runs.append((length, rank, n, first + full, n, width - left))
                add(left - n * length, first + full, 1)
                full, n = full + 1, 0
            add(left, first + full, count - full)
    return runs


def pack(items: DataFrame, order: list[str], width: int = WIDTH) -> DataFrame:
    """items (a table with a long column length, 1 to width) with sequence_id and offset."""
    counts = {r["length"]: r["count"] for r in items.groupBy("length").count().collect()}  # at most `width` rows
    runs = items.sparkSession.createDataFrame(plan(counts, width) or [(0, 0, 0, 0, 1, 0)], "of long, first long, ranks long, sequence long, each long, begin long")
    placed = ranked(items, ["length"], order, F.lit(1), "rank")
    # the runs are bounded by the width, whatever the input: a few thousand
    within = (F.col("length") == F.col("of")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("first") + F.col("ranks"))
    nth = F.col("rank") - F.col("first")
    out = placed.join(F.broadcast(runs), within)
    return out.select(*items.columns, (F.col("sequence") + F.floor(nth / F.col("each"))).alias("sequence_id"), (F.col("begin") + nth % F.col("each") * F.col("length")).alias("offset"))


def op7_packing(spark, sf_dir: str) -> DataFrame:
    cut = pieces(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return packed(cut)


def packed(cut: DataFrame) -> DataFrame:
    """Pieces with their places; of the ids only their checksum is carried on."""
    items = written(cut.withColumn("ids_crc32", F.crc32("ids")).drop("ids"), "pieces")
    return pack(items, ["doc_id", "piece", "ids_crc32"])


QUERIES, ORACLE = {"op7_packing": op7_packing}, {}
