"""Document fingerprints: bottom-k sketches of five-word shingles.

A sketch holds the k smallest 64-bit hashes of a set.  It is
mergeable: the k smallest of two sketches' hashes are the sketch of the union, so parts of a
document or of a corpus can be sketched apart.  From sketches come the resemblance of two sets,
the containment of one in the other and the number of distinct shingles; sets of at most k
shingles are exact.

A null text is the empty text, whose sketch is empty; two empty sketches are alike (1.0), an empty
and another are not (0.0).  Equal texts, and texts that differ only in A-Z case or white space,
have equal fingerprints.  Texts of any length are read whole."""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from rankloom.llm import ranges
from rankloom.llm.common import shingle_set, slices, strings
from rankloom.llm.registry import query, table

# Hashes kept: the standard error of a resemblance is at most 0.5 / sqrt(K).
K = 128


def sketch(text: str, k: int = K) -> np.ndarray:
    return shingle_set(text)[:k]


def merge(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    return np.union1d(a, b)[:k]


def distinct(a: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles."""
    if len(a) < k:
        return float(len(a))
    return (k - 1) / ((float(a[k - 1]) + 1.0) / 2.0**64)


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Share of the union's k smallest hashes that lie in both."""
    if not len(a) or not len(b):
        return 1.0 if len(a) == len(b) else 0.0
    both = merge(a, b, k)
    common = np.isin(both, a, assume_unique=True) & np.isin(both, b, assume_unique=True)
    return float(common.sum()) / len(both)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of the first set that lies in the second."""
    if not len(a):
        return 1.0
    both = distinct(merge(a, b, k), k) * resemblance(a, b, k)
    return min(1.0, both / distinct(a, k))


def to_text(a: np.ndarray) -> str:
    return base64.b64encode(a.astype(">u8").tobytes()).decode("ascii")


def from_text(s: str | None) -> np.ndarray:
    return np.frombuffer(base64.b64decode(s or ""), dtype=">u8").astype(np.uint64)


def fingerprint(df: DataFrame, text: str = "text", out: str = "fingerprint", k: int = K) -> DataFrame:
    """Add the fingerprint of a text column; an existing column of that name is replaced."""
    schema = T.StructType([f for f in df.schema.fields if f.name != out] + [T.StructField(out, T.StringType())])

    def run(batches):
        for part in slices(batches, text):
            prints = pa.array([to_text(sketch(t, k)) for t in strings(part.column(text))], pa.string())
            kept = [n for n in part.schema.names if n != out]
            yield pa.RecordBatch.from_arrays([part.column(n) for n in kept] + [prints], names=kept + [out])

    return df.mapInArrow(run, schema)


def compare(df: DataFrame, a: str, b: str, k: int = K) -> DataFrame:
    """Add resemblance, containment (of a in b) and union_size of two fingerprint columns."""
    names = ["resemblance", "containment", "union_size"]
    schema = T.StructType([f for f in df.schema.fields if f.name not in names] + [T.StructField(n, T.DoubleType()) for n in names])

    def run(batches):
        for batch in batches:
            pairs = [(from_text(x), from_text(y)) for x, y in zip(batch.column(a).to_pylist(), batch.column(b).to_pylist())]
            kept = [n for n in batch.schema.names if n not in names]
            values = [[resemblance(x, y, k) for x, y in pairs], [containment(x, y, k) for x, y in pairs],
                      [distinct(merge(x, y, k), k) for x, y in pairs]]
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in kept] + [pa.array(v, pa.float64()) for v in values], names=kept + names)

    return df.mapInArrow(run, schema)


def merged(df: DataFrame, by: list[str], print_col: str = "fingerprint", k: int = K) -> DataFrame:
    """One fingerprint per group: that of the union of its sets.

    The k smallest distinct hashes are found by a first cut of each task's rows, so a group of any
    size sends at most k hashes per task.  A group of null or empty fingerprints has an empty one."""
    names = by + [print_col]
    schema = T.StructType([df.schema[n] for n in by] + [T.StructField(print_col, T.StringType())])

    def cut(batches):
        kept: dict = {}
        for batch in batches:
            rows = zip(*[batch.column(n).to_pylist() for n in names])
            for *key, value in rows:
                kept[tuple(key)] = merge(kept.get(tuple(key), np.empty(0, np.uint64)), from_text(value), k)
            if len(kept) > 20_000:
                yield pack(kept)
                kept = {}
        if kept:
            yield pack(kept)

    def pack(kept):
        keys = list(zip(*kept)) if by else []
        return pa.RecordBatch.from_pydict({**{n: list(keys[i]) for i, n in enumerate(by)}, print_col: [to_text(v) for v in kept.values()]},
                                          schema=_arrow(schema))

    def final(data: pa.Table) -> pa.Table:
        value = np.empty(0, np.uint64)
        for s in data.column(print_col).to_pylist():
            value = merge(value, from_text(s), k)
        return pa.table([data.column(n).slice(0, 1) for n in by] + [pa.array([to_text(value)])], names=names)

    # two rounds, the first over (group, salt), bound what one call gathers
    salted = df.select(*names).mapInArrow(cut, schema).withColumn("__salt", F.pmod(F.spark_partition_id(), F.lit(64)))
    half = salted.groupBy(*by, "__salt").applyInArrow(final, schema)
    return half.groupBy(*by).applyInArrow(final, schema)


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    return to_arrow_schema(schema)


def neighbours(df: DataFrame, function, schema: T.StructType, key: str = "doc_id", text: str = "text") -> DataFrame:
    """function(key, text, next text) of every row, where the next row is that of the next smaller
    key, and the first row after the last.

    `function` takes lists of (key, text, next text) and returns a record batch of `schema`.  Null
    keys come last; rows of one key are ordered by a hash of the text.  The texts move once, into
    ranges of the key.  The first row of a range also goes to the range before, whose last row needs
    it: which rows these are comes from the keys alone, one per range."""
    rows = ranges.rows_of(df, key, text)
    share = df.sparkSession.sparkContext.broadcast(ranges.edges_of(df, rows))

    def part_of(keys: np.ndarray) -> np.ndarray:
        return ranges.range_of(share.value, keys)

    def locate(batches):
        for batch in batches:
            parts_ = part_of(batch.column("k").to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(parts_, pa.int32()), *[batch.column(n) for n in ("k", "h")]], names=["part", "k", "h"])

    heads = sorted((r["part"], r["s"]["k"], r["s"]["h"]) for r in rows.select("k", "h").mapInArrow(locate, "part int, k long, h long")
                   .groupBy("part").agg(F.max(F.struct("k", "h")).alias("s")).collect())
    # the head of each range in use, and the range before it (before the first: the last)
    copy_to = {(k, h): heads[i - 1][0] for i, (_, k, h) in enumerate(heads)}

    def place(batches):
        names = ["part", "copy", "k", "h", "key", "text"]
        for part in slices(batches, "text"):
            keys, hashes = part.column("k").to_numpy(), part.column("h").to_pylist()
            columns = [part.column(n) for n in names[2:]]
            yield pa.RecordBatch.from_arrays([pa.array(part_of(keys), pa.int32()), pa.array(np.zeros(len(keys), bool)), *columns], names=names)
            twice = [(i, copy_to[kh]) for i, kh in enumerate(zip(keys.tolist(), hashes)) if kh in copy_to]
            if twice:
                at = pa.array([i for i, _ in twice])
                yield pa.RecordBatch.from_arrays([pa.array([p for _, p in twice], pa.int32()), pa.array([True] * len(twice)),
                                                  *[c.take(at) for c in columns]], names=names)

    def run(data: pa.Table) -> pa.Table:
        data = data.sort_by([("copy", "ascending"), ("k", "descending"), ("h", "descending")])
        texts, keys, own = data.column("text"), data.column("key"), len(data) - sum(data.column("copy").to_pylist())
        # after the own rows come copies of the next range's head; equal ones are one text
        out = []
        for start in range(0, own, 256):
            size = min(256, own - start)
            some = texts.slice(start, size + 1).to_pylist()
            if len(some) == size:
                some.append(texts[0].as_py())
            out.append(function([(k, some[i], some[i + 1]) for i, k in enumerate(keys.slice(start, size).to_pylist())]))
        return pa.Table.from_batches(out, schema=_arrow(schema))

    return rows.mapInArrow(place, "part int, copy boolean, k long, h long, key long, text string").groupBy("part").applyInArrow(run, schema)


EDITED = T.StructType([T.StructField(n, k) for n, k in (
    ("doc_id", T.LongType()), ("n_chars", T.LongType()), ("edited_sha256", T.StringType()), ("fingerprint", T.StringType()),
    ("edited_fingerprint", T.StringType()), ("near_edited", T.DoubleType()), ("near_next", T.DoubleType()))])


def edited(rows: list[tuple]) -> pa.RecordBatch:
    """Fingerprints of texts and of their edited texts, whose last third (rounded down, in code
    points) is replaced by as much of the beginning of the next text."""
    out, following = [], None
    for i, (key, text, after) in enumerate(rows):
        own = following if following is not None else sketch(text)
        following = sketch(after)
        third = len(text) // 3
        changed = text[:len(text) - third] + after[:third]
        other = sketch(changed)
        out.append((key, len(text), hashlib.sha256(changed.encode("utf-8")).hexdigest(), to_text(own), to_text(other),
                    resemblance(own, other), resemblance(own, following)))
    return pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*out), _arrow(EDITED))], names=EDITED.names)


@query("op4_bottom_k")
def op4_bottom_k(spark, sf_dir):
    return neighbours(table(spark, sf_dir, "documents").select("doc_id", "text"), edited, EDITED)
