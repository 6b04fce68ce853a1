"""Token ids in files: texts encoded, coded by frequency rank, written, and read back.

A file set is a table with a row per block of at most BLOCK_IDS ids, in ascending document order by
(part, block).  In a block an id is replaced by its rank (0 for the most frequent id, ties to the
smaller id) and coded in 1 to 4 bytes, little end first.  The lengths, less one, stand apart in
control bytes, two bits each, the first value in the lowest bits.  Columns: part, block, doc_ids and
lengths (ids per document), ids (their number), ranks (the ids in rank order, unsigned 32-bit),
control, data.  Decoding looks the lengths of four values up by control byte.

A null text is the empty text: it has the end id only.  Documents are ordered by doc_id, null first,
repeated ones by a hash of the text.  Existing blocks are never changed; a failed write leaves no
block behind, as Spark commits the files.  An empty table gives an empty file set."""

from __future__ import annotations

import os
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from rankloom import runtime
from rankloom.llm import ranges
from rankloom.llm.common import slices
from rankloom.llm.pretokens import cut, gathered
from rankloom.llm.registry import query, table

VOCABULARY = "byte_bpe_50k.json"
END_ID = 0
BLOCK_IDS = 4_000_000
# Units remembered per Python worker: as many again in the store before, from which those in use move over.
MEMORY_UNITS = 300_000
# Text bytes that are cut and coded at once; longer texts come alone.
SLICE_BYTES = 4 * 1024 * 1024
# Stands between texts that are merged in one call; no token but its own has this byte.
GAP = "\0"

BLOCKS = "part int, block int, doc_ids array<bigint>, lengths array<bigint>, ids bigint, ranks binary, control binary, data binary"

# Lengths of the four values of each control byte.
LENGTHS = np.array([[(c >> (2 * i) & 3) + 1 for i in range(4)] for c in range(256)], dtype=np.uint8)


def code(ids: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """(ranks, control, data) of the ids of a block."""
    top = int(ids.max(initial=0)) + 1
    if top <= 1 << 22:  # a table of all ids is small
        tally = np.bincount(ids, minlength=top)
        values, spot = np.flatnonzero(tally), ids
        counts = tally[values]
    else:
        values, spot, counts = np.unique(ids, return_inverse=True, return_counts=True)
    order = np.argsort(-counts, kind="stable")
    place = np.empty(top if spot is ids else len(values), dtype="<u4")
    place[values[order] if spot is ids else order] = np.arange(len(values), dtype="<u4")
    codes = place[spot]
    sizes = (codes >= 1 << 8).astype(np.uint8) + (codes >= 1 << 16) + (codes >= 1 << 24)
    padded = np.zeros(-(-len(codes) // 4) * 4, dtype=np.uint8)
    padded[:len(codes)] = sizes
    control = (padded.reshape(-1, 4) << np.array([0, 2, 4, 6], dtype=np.uint8)).sum(axis=1, dtype=np.uint8)
    width = int(sizes.max(initial=0)) + 1
    data = codes.view(np.uint8).reshape(-1, 4)[:, :width][np.arange(width) <= sizes[:, None]]
    return values[order].astype("<u4").tobytes(), control.tobytes(), data.tobytes()


def decode(ranks: bytes, control: bytes, data: bytes, n: int) -> np.ndarray:
    """The ids of a block."""
    sizes = LENGTHS[np.frombuffer(control, dtype=np.uint8)].ravel()[:n]
    width = int(sizes.max(initial=1))
    cells = np.zeros((n, 4), dtype=np.uint8)
    cells[:, :width][np.arange(width) < sizes[:, None]] = np.frombuffer(data, dtype=np.uint8)
    return np.frombuffer(ranks, dtype="<u4")[cells.view("<u4").ravel()]


class Encoder:
    """The library's tokenizer, asked once for each match of the split pattern."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        # matches of the pattern, joined by a byte that no merge has, are merged in one call of the library
        self.whole = Tokenizer.from_file(path)
        # added tokens are cut out of the texts before, as the library does
        added = {t.content: i for i, t in self.whole.get_added_tokens_decoder().items()}
        self.added = {content: np.array([i], dtype="<u4").tobytes() for content, i in added.items()}
        self.cutter = regex.compile("(" + "|".join(map(regex.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self.whole.encode_special_tokens = True
        self.whole.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.gap, = self.whole.encode(GAP, add_special_tokens=False).ids
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _ids(self, pieces: list[str]) -> list[bytes]:
        """Ids of matches of the pattern."""
        out: list[bytes] = []
        for start in range(0, len(pieces), 128):
            some = pieces[start:start + 128]
            joined = GAP.join(some)
            if joined.count(GAP) >= len(some):
                out += [np.array(e.ids, dtype="<u4").tobytes() for e in self.whole.encode_batch_fast(some, add_special_tokens=False)]
                continue
            ids = np.array(self.whole.encode_batch_fast([joined], add_special_tokens=False)[0].ids, dtype="<u4")
            cuts = 4 * np.flatnonzero(ids == self.gap)
            raw = ids.tobytes()
            out += map(raw.__getitem__, map(slice, [0, *(cuts + 4).tolist()], [*cuts.tolist(), len(raw)]))
        return out

    def _learn(self, new: list[str]) -> None:
        known = self.known
        words, others = [], []
        for u in new:
            body = u[1:] if u[0] == " " else u
            simple = body.isalpha() and (body.isascii() or max(body) < "\u0250")
            (words if simple else others).append(u)
        known.update(zip(words, self._ids(words)))
        split = list(map(self.pattern.findall, others))
        pieces = list({p for parts in split for p in parts if p not in known})
        known.update(zip(pieces, self._ids(pieces)))
        for u, parts in zip(others, split):
            if len(parts) > 1:
                known[u] = b"".join(map(known.__getitem__, parts))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, as bytes of unsigned 32-bit integers; an added token in a text has its own id."""
        holding = [n for n, t in enumerate(texts) if any(a in t for a in self.added)]
        if not holding:
            return self._encode(texts)
        parts = {n: self.cutter.split(texts[n]) for n in holding}
        plain = self._encode([*(t for n, t in enumerate(texts) if n not in parts), *(p for some in parts.values() for p in some[::2])])
        rest = iter(plain[len(texts) - len(holding):])
        joined = {n: b"".join(self.added[p] if at % 2 else next(rest) for at, p in enumerate(some)) for n, some in parts.items()}
        others = iter(plain)
        return [joined[n] if n in joined else next(others) for n in range(len(texts))]

    def _encode(self, texts: list[str]) -> list[bytes]:
        if len(self.known) > MEMORY_UNITS:
            self.known, self.older = {}, self.known
        found, places, counts = cut(texts, self.pattern)
        got = list(map(self.known.get, found))
        missing = [i for i, ids in enumerate(got) if ids is None]
        if missing:
            new = [found[i] for i in missing]
            if self.older:
                self.known.update((u, self.older[u]) for u in new if u in self.older)
                new = [u for u in new if u not in self.known]
            self._learn(new)
            for i in missing:
                got[i] = self.known[found[i]]
        ids, ends = gathered(got, places, counts)
        raw, stops = ids.tobytes(), (4 * ends).tolist()
        return list(map(raw.__getitem__, map(slice, [0, *stops[:-1]], stops)))


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def write(df: DataFrame, folder: str, key: str = "doc_id", text: str = "text", path: str | None = None) -> None:
    """Encode every text, append the end id, and write the file set to `folder`."""
    path = path or public_tokenizers.path(VOCABULARY)
    rows = ranges.rows_of(df, key, text)
    end = np.array([END_ID], dtype="<u4").tobytes()

    def blocks(data: pa.Table) -> pa.Table:
        part = data.column("part")[0].as_py()
        data = data.select(["k", "h", "key", "text"]).sort_by([("k", "ascending"), ("h", "ascending")])
        out, keys, texts = [], [], []

        def flush():
            ids = np.frombuffer(b"".join(texts), dtype="<u4")
            out.append({"part": part, "block": len(out), "doc_ids": keys, "lengths": [len(t) // 4 for t in texts], "ids": len(ids),
                        **dict(zip(("ranks", "control", "data"), code(ids)))})

        size = 0
        for batch in slices(data.combine_chunks().to_batches(), "text", SLICE_BYTES):
            for k, ids in zip(batch.column("key").to_pylist(), encoder(path).encode(batch.column("text").to_pylist())):
                if keys and size + len(ids) // 4 + 1 > BLOCK_IDS:
                    flush()
                    keys, texts, size = [], [], 0
                keys.append(k)
                texts.append(ids + end)
                size += len(ids) // 4 + 1
        flush()
        return pa.Table.from_pylist(out, schema=_blocks())

    ranges.dealt(rows, ranges.edges_of(df, rows)).groupBy("part").applyInArrow(blocks, BLOCKS).write.parquet(folder)


def _blocks() -> pa.Schema:
    return pa.schema([("part", pa.int32()), ("block", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())),
                      ("ids", pa.int64()), ("ranks", pa.binary()), ("control", pa.binary()), ("data", pa.binary())])


def open_set(spark: SparkSession, folder: str) -> DataFrame:
    """The blocks of a file set, with `start`: the number of ids before each.

    Starts come from the blocks' counts; the one-task sum is over one row per block."""
    files = spark.read.schema(BLOCKS).parquet(folder)
    starts = files.select("part", "block", "ids").withColumn(
        "start", F.sum("ids").over(Window.orderBy("part", "block").rowsBetween(Window.unboundedPreceding, -1))).select(
        "part", "block", F.coalesce("start", F.lit(0)).alias("start"))
    return files.join(F.broadcast(starts) if starts.count() <= 1_000_000 else starts, ["part", "block"])


def read(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, ids) of every document of a file set; ids as bytes of unsigned 32-bit integers."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids = decode(row["ranks"], row["control"], row["data"], row["ids"]).astype("<u4").tobytes()
                ends = np.cumsum(row["lengths"])
                for first in range(0, len(ends), 2048):
                    some = ends[first:first + 2048].tolist()
                    begins = [int(ends[first - 1]) if first else 0, *some[:-1]]
                    yield pa.RecordBatch.from_arrays([
                        pa.array(row["doc_ids"][first:first + 2048], pa.int64()), pa.array([row["start"] + b for b in begins], pa.int64()),
                        pa.array([ids[4 * b:4 * e] for b, e in zip(begins, some)], pa.binary())], names=["doc_id", "start", "ids"])

    return open_set(spark, folder).mapInArrow(run, "doc_id long, start long, ids binary")


@query("op6_rank_varint")
def op6_rank_varint(spark, sf_dir):
    folder = runtime.scratch_path(spark, "token-files")
    write(table(spark, sf_dir, "documents").select("doc_id", "text"), folder)
    return read(spark, folder).select("doc_id", "start", (F.length("ids") / 4).cast("bigint").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
