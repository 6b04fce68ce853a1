"""Byte-level BPE: texts to token ids by a rank file, and ids back to bytes.

Every match of the split pattern is encoded alone.  A segment tree over its byte positions holds
at each node the smallest (rank, position) of the pairs below it, so the root is the leftmost pair
of least rank.  A merge changes three leaves: the pair's own, the absorbed neighbour's and that of
the token before; each change walks up one path.  Trees of pieces of like length are rows of one
numpy array and take their merges together.

Nulls are encoded as the empty text; an empty text has no ids and decodes to no bytes.  Repeated
rows give equal ids.  Other columns pass unchanged; existing columns of the output names are
replaced.  A piece of n bytes takes O(n log n) steps, so one very long piece is no trouble."""

from __future__ import annotations

import base64
from functools import lru_cache
from typing import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame, functions as F, types as T

from rankloom.llm.common import slices, strings
from rankloom.llm.pretokens import cut, gathered
from rankloom.llm.registry import query, table

VOCABULARY = "byte_bpe_50k.tiktoken"
# Units remembered per Python worker: as many again in the store before, from which those in use move over.
MEMORY_UNITS = 150_000
# Cells of the trees that are merged together.
TREE_CELLS = 1 << 16

_NONE = np.int64(1) << np.int64(62)


class Coder:
    """Encoder and decoder of one rank file."""

    def __init__(self, path: str, pattern: str = public_tokenizers.PATTERN):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.pattern = regex.compile(pattern)
        self.bytes_of = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.bytes_of[rank] = token
        self.spelled = pa.array(self.bytes_of, pa.large_binary())
        self.single = np.array([self.ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        pairs = {}
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                a, b = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if a is not None and b is not None:
                    pairs[(a << 32) | b] = rank
        self.pair_keys = np.array(sorted(pairs), dtype=np.int64)
        self.pair_ranks = np.array([pairs[k] for k in self.pair_keys.tolist()], dtype=np.int64)
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def forget(self) -> None:
        self.known, self.older = {}, {}

    def pair_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the token that a pair joins to, or -1."""
        key = (a << 32) | b
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], -1)

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each piece (bytes, not empty), as bytes of 32-bit integers, little end first."""
        out: list[bytes] = [b""] * len(pieces)
        by_width: dict[int, list[int]] = {}
        for i, piece in enumerate(pieces):
            rank = self.ranks.get(piece)
            if rank is not None:
                out[i] = rank.to_bytes(4, "little")
            else:
                by_width.setdefault(1 << (len(piece) - 1).bit_length(), []).append(i)
        for width, members in by_width.items():
            step = max(1, TREE_CELLS // width)
            for start in range(0, len(members), step):
                part = members[start:start + step]
                for i, ids in zip(part, self._merge_rows([pieces[i] for i in part], width)):
                    out[i] = ids
        return out

    def _merge_rows(self, pieces: list[bytes], width: int) -> Iterator[bytes]:
        rows = len(pieces)
        sizes = np.array([len(p) for p in pieces])
        cells = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), dtype=np.uint8).reshape(rows, width)
        # one column more on the right, so that the last token has a neighbour to look at
        tokens = np.full((rows, width + 1), -1, dtype=np.int64)
        tokens[:, :width] = np.where(np.arange(width) < sizes[:, None], self.single[cells], -1)
        after = np.minimum(np.arange(1, width + 2), width) * np.ones((rows, 1), dtype=np.int64)
        before = (np.arange(width + 1) - 1) * np.ones((rows, 1), dtype=np.int64)
        live = np.arange(width) < sizes[:, None]
        tree = np.full((rows, 2 * width), _NONE, dtype=np.int64)
        first = self.pair_rank(np.maximum(tokens[:, :-1], 0), np.maximum(tokens[:, 1:], 0))
        first = np.where((tokens[:, :-1] >= 0) & (tokens[:, 1:] >= 0), first, -1)
        tree[:, width:] = np.where(first >= 0, first * width + np.arange(width), _NONE)
        level = width
        while level > 1:
            half = level // 2
            tree[:, half:level] = np.minimum(tree[:, level:2 * level:2], tree[:, level + 1:2 * level:2])
            level = half
        active = np.flatnonzero(tree[:, 1] < _NONE)
        while len(active):
            rank, at = np.divmod(tree[active, 1], width)
            gone = after[active, at]
            following = after[active, gone]
            previous = before[active, at]
            tokens[active, at] = rank
            live[active, gone] = False
            after[active, at] = following
            before[active, following] = at
            self._set(tree, active, gone, np.full(len(active), _NONE), width)
            self._set(tree, active, at, self._leaf(tokens, active, at, following, width), width)
            has = previous >= 0
            if has.any():
                r, p = active[has], previous[has]
                self._set(tree, r, p, self._leaf(tokens, r, p, at[has], width), width)
            active = active[tree[active, 1] < _NONE]
        flat = tokens[:, :width][live].astype("<i4").tobytes()
        ends = (4 * np.cumsum(live.sum(axis=1))).tolist()
        return map(flat.__getitem__, map(slice, [0, *ends[:-1]], ends))

    def _leaf(self, tokens, rows, left, right, width):
        a, b = tokens[rows, left], tokens[rows, right]
        rank = self.pair_rank(np.maximum(a, 0), np.maximum(b, 0))
        return np.where((a >= 0) & (b >= 0) & (rank >= 0), rank * width + left, _NONE)

    @staticmethod
    def _set(tree, rows, at, value, width):
        node = at + width
        tree[rows, node] = value
        while width > 1:
            node = node >> 1
            tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])
            width >>= 1

    def encode_flat(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and the end of each text there.  Units already met come from the store,
        all others merge at once."""
        if len(self.known) > MEMORY_UNITS:
            self.known, self.older = {}, self.known
        found, places, counts = cut(texts, self.pattern)
        known, older = self.known, self.older
        new = [u for u in found if u not in known]
        known.update((u, older[u]) for u in new if u in older)
        words, split = [], {}
        for u in new:
            if u not in known:
                body = u[1:] if u[0] == " " else u
                if body.isalpha() and body.isascii():  # one match of the pattern
                    words.append(u)
                else:
                    split[u] = self.pattern.findall(u)
        pieces = [*words, *{p for parts in split.values() for p in parts if p not in known}.difference(words)]
        known.update(zip(pieces, self.merge([p.encode("utf-8") for p in pieces])))
        for unit, parts in split.items():
            if len(parts) > 1:
                known[unit] = b"".join(map(known.__getitem__, parts))
        return gathered(list(map(known.__getitem__, found)), places, counts)

    def encode_all(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text."""
        flat, ends = self.encode_flat(texts)
        ids, stops = flat.tolist(), ends.tolist()
        return list(map(ids.__getitem__, map(slice, [0, *stops[:-1]], stops)))

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


@lru_cache(maxsize=4)
def coder(path: str) -> Coder:
    return Coder(path)


def _with_column(batch: pa.RecordBatch, name: str, values: pa.Array) -> pa.RecordBatch:
    names = [n for n in batch.schema.names if n != name]
    return pa.RecordBatch.from_arrays([batch.column(n) for n in names] + [values], names=names + [name])


def _appended(df: DataFrame, name: str, kind: T.DataType) -> T.StructType:
    return T.StructType([f for f in df.schema.fields if f.name != name] + [T.StructField(name, kind)])


def encode(df: DataFrame, path: str | None = None, text: str = "text", ids: str = "ids") -> DataFrame:
    """Add the token ids of `text` as an array of integers."""
    path = path or public_tokenizers.path(VOCABULARY)

    def run(batches):
        c = coder(path)
        c.forget()  # what another task left in this worker
        for part in slices(batches, text, 4 * 1024 * 1024):
            flat, ends = c.encode_flat(strings(part.column(text)))
            offsets = np.concatenate([[0], ends]).astype(np.int32)
            yield _with_column(part, ids, pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.view(np.int32))))
        c.forget()  # idle workers keep no store

    return df.mapInArrow(run, _appended(df, ids, T.ArrayType(T.IntegerType())))


def decode(df: DataFrame, path: str | None = None, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Add the bytes that an array of ids stands for; a null array gives no bytes."""
    path = path or public_tokenizers.path(VOCABULARY)

    def run(batches):
        c = coder(path)
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                column = part.column(ids)
                # the tokens' bytes one after the other; a text is what lies between two of their borders
                taken = c.spelled.take(column.flatten())
                borders = np.frombuffer(taken.buffers()[1], dtype=np.int64)[taken.offset:taken.offset + len(taken) + 1]
                ends = np.cumsum(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
                offsets = borders[np.concatenate([[0], ends])] if len(taken) else np.zeros(len(column) + 1, dtype=np.int64)
                got = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(column), [None, pa.py_buffer(offsets.astype(np.int64)), taken.buffers()[2]])
                yield _with_column(part, out, got.cast(pa.binary()))

    return df.mapInArrow(run, _appended(df, out, T.BinaryType()))


@query("op1_byte_bpe")
def op1_byte_bpe(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = decode(encode(docs).drop("text"))
    return coded.select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))
