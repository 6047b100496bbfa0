"""Personal data by patterns and a skip-chain conditional random field.

Nodes are a document's segments that look like personal data at all: pattern matches (their labels are
given) and other runs of digits or signs around an @. Neighbours share a chain potential; occurrences of the
same or nearly the same content (equal without signs and case, or equal last digits) share a skip potential,
each with the next one, however far apart. Loopy sum-product messages carry labels over both; a segment
without a pattern's label that ends at SURE or more with a label becomes a span. Pattern spans always stay.
Every document with such a segment is inferred, whether a pattern matched in it or not.

The fit reads the nodes (at most NODES each) of a bounded sample of documents (SAMPLE, the smallest hashes of their
ids). Patterns label what they match and nothing else, so labelled nodes are also written in ways that no pattern
matches (without +, with other signs), as further mentions in the same document, which keep the label; what is not matched
there is labelled as no personal data. Unary, chain and skip weights are fitted together by pseudo-likelihood.

Defined cases: a null or empty text has no spans; repeated rows are treated alike; an empty table gives an
empty result; ties between labels go to the first listed; very long texts take time in proportion to their length;
only doc_id and text are read, and redacted() leaves other columns, whatever their names, as they were.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import texts

#: The contract's kinds in their order, and their patterns.
KINDS = ("email", "ip", "card", "phone")
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: EMAIL behind the @, and IP, so that no place of a run is tried twice.
_HOST = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
#: Other segments that nodes are made of: runs around an @, and of digits with signs.
_AROUND = re.compile(r"[^\s<>()\[\],;:\"']*")
_BREAK = frozenset(" \t\n\r\f\v<>()[],;:\"'")
_RUN = re.compile(r"\(?[0-9][0-9().\x20/-]{5,}[0-9]")
#: Documents and nodes of each that the fit reads at most; rounds of messages; the belief from which a label counts.
SAMPLE, NODES, ROUNDS, SURE = 8192, 64, 12, 0.9
FEATURES = 14


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """What EMAIL finds, by way of each @: the run before it, and the host behind it."""
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        m = _HOST.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            last = m.end()
        at = text.find("@", m.end() if m else at + 1)


def base(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end) of what the patterns find, by kind, then start."""
    out = []
    if "@" in text:
        out += [(0, *span) for span in _emails(text)]
    if any(d in text for d in "0123456789"):
        if "." in text:
            out += [(1, *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.group().split("."))]
        out += [(2, *m.span()) for m in CARD.finditer(text) if 16 <= len(d := _digits(m.group())) <= 19 and _luhn(d)]
        if "+" in text:
            out += [(3, *m.span()) for m in PHONE.finditer(text) if 8 <= len(_digits(m.group())) <= 15]
    return out


def others(text: str) -> list[tuple[int, int]]:
    """Segments around an @ and runs of digits that stand alone, in order, not overlapping."""
    found, last = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] not in _BREAK and not text[start - 1].isspace():
            start -= 1
        end = _AROUND.match(text, at).end()
        if start < at and end > at + 1:
            found.append((start, end))
        last = end
        at = text.find("@", max(end, at + 1))
    for m in _RUN.finditer(text):
        s, e = m.span()
        if (s and text[s - 1].isalnum()) or (e < len(text) and text[e].isalnum()):
            continue  # a part of something longer
        found.append((s, e))
    out, last = [], 0
    for s, e in sorted(found):
        if s >= last:
            out.append((s, e))
            last = e
    return out


def nodes(text: str, found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(label or 0, start, end) in order; labels are kind numbers + 1. Segments that touch a pattern's span aren't nodes of their own."""
    spans = sorted((s, e, k + 1) for k, s, e in found)
    last = 0
    own = []
    for s, e, k in spans:  # of spans that overlap, one node
        if s >= last:
            own.append((k, s, e))
            last = e
    out, i = [], 0
    for s, e in others(text):
        while i < len(own) and own[i][2] <= s:
            i += 1
        if i == len(own) or own[i][1] >= e:
            out.append((0, s, e))
    return sorted(own + out, key=lambda n: n[1])


def content(segment: str) -> str:
    """What repeated or similar segments have in common; empty: nothing to compare."""
    if "@" in segment:
        return "@" + "".join(c for c in segment.lower() if c.isalnum())
    d = _digits(segment)
    if len(d) >= 8:
        return d[-9:]
    groups = re.findall("[0-9]+", segment)
    return ".".join(groups) if len(groups) > 3 else ""


def _features(seg: str) -> list[float]:
    d = _digits(seg)
    groups = re.findall("[0-9]{1,30}", seg)
    four = len(groups) == 4 and all(len(g) <= 3 and int(g) <= 255 for g in groups)
    at = "@" in seg
    return [1, at, at and any(c.isalpha() for c in seg.partition("@")[2]), not at and seg[0] == "+", not at and four, len(d) < 8, 8 <= len(d) <= 15, 16 <= len(d) <= 19, " " in seg, "-" in seg, "(" in seg, 16 <= len(d) <= 19 and _luhn(d), "." in seg, 8 <= len(d) <= 15 and 3 <= len(groups) <= 5]


def _links(contents: list[str]) -> list[tuple[int, int]]:
    last: dict[str, int] = {}
    out = []
    for i, c in enumerate(contents):
        if c:
            if c in last:
                out.append((last[c], i))
            last[c] = i
    return out


def links(text: str, own: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Skip edges: each node to the next one of the same content."""
    return _links([content(text[s:e]) for _, s, e in own])


def rewritten(kind: int, segment: str) -> list[str]:
    """The same personal data in ways that no pattern matches."""
    if kind == 1:
        name, _, host = segment.partition("@")
        return [f"{name}@{host.replace('.', '_')}", f"{name.upper()}@{host.replace('.', '/')}"]
    d = re.findall("[0-9]+", segment)
    if kind == 2:
        return ["-".join(d), " ".join(d)]
    if kind == 3:
        whole = "".join(d)
        return [".".join(whole[i : i + 4] for i in range(0, len(whole), 4)), "/".join(whole[i : i + 4] for i in range(0, len(whole), 4))]
    return ["00" + " ".join(d), ".".join(d[1:]) if len("".join(d[1:])) > 7 else "".join(d), f"({d[0]}) " + " ".join(d[1:]) if len(d) > 1 else "00" + d[0]]


def example(text: str) -> list[tuple[list[float], int, str, bool]]:
    """(features, label, content, whether it is on the chain) of a document's first nodes, and of each labelled one written
    otherwise as further mentions, which have no neighbours."""
    own = nodes(text, base(text))[:NODES]
    out = [(_features(text[s:e]), k, content(text[s:e]), True) for k, s, e in own]
    return out + [(_features(x), k, content(x), False) for k, s, e in own if k for x in rewritten(k, text[s:e])]


def fit(sample: list[list[tuple[list[float], int, str, bool]]], rounds: int = 500, rate: float = 0.5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(unary weights, chain potentials, skip potentials) by pseudo-likelihood: each label given its neighbours' on the chain
    and over skips. sample: of each document what example() gives."""
    labels = len(KINDS) + 1
    x, y = [], []
    edges: list[list[tuple[int, int]]] = [[], []]  # chain, skip
    for rows in sample:
        at = len(y)
        x += [r[0] for r in rows]
        y += [r[1] for r in rows]
        edges[0] += [(at + i, at + i + 1) for i in range(len(rows) - 1) if rows[i + 1][3]]
        edges[1] += [(at + a, at + b) for a, b in _links([r[2] for r in rows])]
    w, tables = np.zeros((FEATURES, labels)), [np.zeros((labels, labels)), np.zeros((labels, labels))]
    if not y:
        return w, *tables
    x, y, one = np.array(x, float), np.array(y), np.eye(labels)
    before, after = [], []  # the neighbours' labels, summed: skips and chain have one on each side at most
    for pairs in edges:
        left, right = np.zeros((len(y), labels)), np.zeros((len(y), labels))
        for a, b in pairs:
            left[b] += one[y[a]]
            right[a] += one[y[b]]
        before.append(left)
        after.append(right)
    weight = (len(y) / np.maximum(np.bincount(y, minlength=labels), 1))[y] ** 0.5
    weight /= weight.sum()
    for _ in range(rounds):
        z = x @ w + sum(before[i] @ tables[i] + after[i] @ tables[i].T for i in (0, 1))
        p = np.exp(z - z.max(1, keepdims=True))
        g = (one[y] - p / p.sum(1, keepdims=True)) * weight[:, None]
        w += rate * (x.T @ g - 1e-4 * w)
        for i in (0, 1):
            tables[i] += rate * (before[i].T @ g + g.T @ after[i] - 1e-4 * tables[i])
    return w, *tables


def beliefs(unary: np.ndarray, given: list[int], chain: np.ndarray, skip: np.ndarray, skips: list[tuple[int, int]]) -> np.ndarray:
    """Loopy sum-product over the chain and the skips; given labels are fixed."""
    m, labels = unary.shape
    local = np.exp(unary - unary.max(1, keepdims=True))
    for i, k in enumerate(given):
        if k:
            local[i] = np.eye(labels)[k]
    pairs = [(i, i + 1, chain) for i in range(m - 1)] + [(a, b, skip) for a, b in skips]
    edges = [(a, b, np.exp(t - t.max())) for a, b, t in pairs] + [(b, a, np.exp(t - t.max()).T) for a, b, t in pairs]
    source, target = np.array([a for a, _, _ in edges]), np.array([b for _, b, _ in edges])
    table = np.stack([t for _, _, t in edges]) if edges else np.zeros((0, labels, labels))
    back = (np.arange(len(edges)) + len(pairs)) % max(len(edges), 1)
    log = np.zeros((len(edges), labels))
    for _ in range(ROUNDS):
        if not len(edges):
            break
        total = np.log(np.maximum(local, 1e-30))
        np.add.at(total, target, log)
        out = total[source] - log[back]  # all that a node has heard, but from whom it tells
        out = np.exp(out - out.max(1, keepdims=True))
        new = np.einsum("ei,eij->ej", out, table)
        log = 0.5 * log + 0.5 * np.log(np.maximum(new / new.sum(1, keepdims=True), 1e-30))
    total = np.log(np.maximum(local, 1e-30))
    if len(edges):
        np.add.at(total, target, log)
    b = np.exp(total - total.max(1, keepdims=True))
    return b / b.sum(1, keepdims=True)


def spans(text: str, model: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[list, list]:
    """(base spans, all spans), each (kind number, start, end) by kind, then start."""
    found = base(text)
    own = nodes(text, found)
    if all(k for k, _, _ in own):
        return found, found
    w, chain, skip = model
    b = beliefs(np.array([_features(text[s:e]) for _, s, e in own], float) @ w, [k for k, _, _ in own], chain, skip, links(text, own))
    more = [(int(b[i].argmax()) - 1, s, e) for i, (k, s, e) in enumerate(own) if not k and b[i].argmax() and b[i].max() >= SURE]
    return found, sorted(found + more)


def trained(docs: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    # ids are chosen before texts are read: a task's share of a top-k is as large as all of it
    kept = docs.select("doc_id").where("doc_id IS NOT NULL").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [json.dumps(x) for t in batch.column(0).to_pylist() if (x := example(t))]
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.string())], ["nodes"])

    rows = texts(docs).join(F.broadcast(kept), "doc_id").select("text").mapInArrow(scan, "nodes string")
    rows = rows.distinct().orderBy(F.xxhash64("nodes"), "nodes").limit(SAMPLE).collect()  # documents of a few ids, at most NODES nodes each
    return fit([json.loads(r["nodes"]) for r in rows])


def find(docs: DataFrame) -> DataFrame:
    """(doc_id, base, spans): arrays of (kind, start, end)."""
    model = trained(docs)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = [spans(t, model) for t in batch.column(1).to_pylist()]
            named = [[[{"kind": KINDS[k], "start": s, "end": e} for k, s, e in pair[i]] for pair in both] for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(named[0], kind), pa.array(named[1], kind)], ["doc_id", "base", "spans"])

    one = "array<struct<kind:string,start:int,end:int>>"
    return texts(docs).mapInArrow(scan, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, base {one}, spans {one}")


def redacted(docs: DataFrame) -> DataFrame:
    """docs, with each span in the text replaced by its kind in brackets; n_chars, if there, follows."""
    model = trained(docs)
    schema = docs.schema
    at = schema.names.index("text")

    def cut(text: str | None) -> str | None:
        if not text:
            return text
        out, last = [], 0
        for s, e, k in sorted((s, e, k) for k, s, e in spans(text, model)[1]):
            if s >= last:
                out += [text[last:s], f"[{KINDS[k].upper()}]"]
            last = max(last, e)
        return "".join(out) + text[last:]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.set_column(at, batch.schema.field(at), pa.array([cut(t) for t in batch.column(at).to_pylist()], batch.schema.field(at).type))

    out = docs.mapInArrow(scan, schema)
    return out.withColumn("n_chars", F.length("text").cast(schema["n_chars"].dataType)) if "n_chars" in schema.names else out


def op6_pii(spark, sf_dir: str) -> DataFrame:
    found = find(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, KINDS), F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))


QUERIES, ORACLE = {"op6_pii": op6_pii}, {}
