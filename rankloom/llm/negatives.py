"""Hard negatives of anchor vectors, by exact integer scores from packed products.

A block of vectors is packed component by component: the values of one component, made non-negative
by a bias, lie in separated fields of one wide integer.  One multiplication by an anchor's component
moves all of them, and the sum over the components holds every score of the block, plus a known
offset, in its field.  Fields are as wide as the largest possible sum of the two blocks, so no field
runs into the next and scores are exact.

Anchors and vectors are dealt into blocks by a hash; each pair of blocks is one group of a cogroup,
and what it passes on is at most K rows per anchor and positive.  No list of all scores is made.

Rows that take no part: a null id, label or vector, and any component that is null or not finite.
Repeated rows (same id, label and vector) count once.  Rows with the anchor's id are never its
positives; vectors of other lengths than the anchor's are not compared with it, and those of length 0
have the score 0.  Components are kept within +-2^62 and scores within +-(2^63 - 1).  An anchor
without another row of its label, and a positive without a fitting negative, give no rows; neither
does an empty table.  Other columns are not read."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from rankloom.llm.common import stored
from rankloom.llm.registry import query, table

SCALE = 256
# Rows of a block of vectors and of a block of anchors.
BLOCK_ROWS = 2048
ANCHOR_ROWS = 1024
POSITIVES = 5
NEGATIVES = 5

_TOP = (1 << 63) - 1


class Packed:
    """Vectors (rows of integers) as one wide integer per component, for anchors whose components
    are at most `reach` in size."""

    def __init__(self, block: np.ndarray, reach: int):
        self.rows, self.dim = block.shape
        self.low = int(block.min(initial=0))
        top = int(block.max(initial=0)) - self.low
        self.most = self.dim * reach * top  # no sum of biased products is larger, with either sign
        bits = max(2 * self.most, top).bit_length()
        self.width = 4 if bits <= 32 else 8 * -(-bits // 64)
        biased = block.astype(np.uint64) - np.uint64(self.low % (1 << 64))
        self.packs = [self._packed(biased[:, k]) for k in range(self.dim)]
        self.offset = self.most * self._packed(np.ones(self.rows, dtype=np.uint64))
        self.narrow = self.dim * reach * max(abs(self.low), top + abs(self.low)) < 1 << 62 and self.width <= 8

    def _packed(self, values: np.ndarray) -> int:
        if self.width == 4:
            return int.from_bytes(values.astype("<u4").tobytes(), "little")
        cells = np.zeros((len(values), self.width // 8), dtype="<u8")
        cells[:, 0] = values
        return int.from_bytes(cells.tobytes(), "little")

    def scores(self, anchor: list[int]) -> np.ndarray:
        """Inner products of the anchor with every row."""
        total = self.offset
        for component, pack in zip(anchor, self.packs):
            if component:
                total += component * pack
        raw = total.to_bytes(self.rows * self.width, "little")
        shift = self.low * sum(anchor) - self.most
        if self.narrow:
            fields = np.frombuffer(raw, dtype=f"<u{self.width}").astype(np.uint64)
            return (fields + np.uint64(shift % (1 << 64))).view(np.int64)
        return np.array([max(-_TOP, min(_TOP, int.from_bytes(raw[at:at + self.width], "little") + shift))
                         for at in range(0, len(raw), self.width)], dtype=np.int64)


def _matrix(data: pa.Table) -> np.ndarray:
    column = data.column("q").combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0), dtype=np.int64)


def _reach(anchors: np.ndarray) -> int:
    return max(abs(int(anchors.min(initial=0))), abs(int(anchors.max(initial=0))))


def prepared(df: DataFrame, key: str = "vec_id", label: str | Column = "label", vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(id, label, q, h): the rows that take part, their components scaled and rounded down; h tells
    rows of one id apart."""
    rows = df.select(F.col(key).cast("bigint").alias("id"), (F.col(label) if isinstance(label, str) else label).cast("bigint").alias("label"),
                     F.col(vector).cast("array<double>").alias("v"))
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    bound = float(1 << 62)
    whole = rows.where("id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL").where(sound).select(
        "id", "label", F.transform("v", lambda x: F.floor(F.greatest(F.lit(-bound), F.least(F.lit(bound), x * F.lit(float(scale)))))).alias("q"))
    return whole.distinct().withColumn("h", F.xxhash64("label", "q"))


def _met(anchors: DataFrame, rows: DataFrame, blocks: tuple[int, int], run, schema: str) -> DataFrame:
    """`run` on every pair of a block of anchors and a block of rows of one length."""
    a, b = blocks
    numbered = lambda df, n: F.pmod(F.xxhash64("id", "h"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dim = F.size("q").alias("dim")
    left = anchors.select("*", dim, numbered(anchors, a).alias("a"), every(b).alias("b"))
    right = rows.select("*", dim, numbered(rows, b).alias("b"), every(a).alias("a"))
    return left.groupBy("dim", "a", "b").cogroup(right.groupBy("dim", "a", "b")).applyInArrow(run, schema)


def _block_counts(anchors: DataFrame, rows: DataFrame) -> tuple[int, int]:
    return max(1, -(-anchors.count() // ANCHOR_ROWS)), max(1, -(-rows.count() // BLOCK_ROWS))


def _first(df: DataFrame, by: list[str], score: str, key: str, n: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.col(score).desc(), F.col(key).asc())
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


_FOUND = "anchor_id long, h long, positive_id long, positive_score long"


def nearest_alike(anchors: DataFrame, rows: DataFrame, n: int = POSITIVES) -> DataFrame:
    """(anchor_id, h, positive_id, positive_score, rank): for each anchor its first n other rows of the same label."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if left.num_rows and right.num_rows:
            right = right.sort_by([("label", "ascending"), ("id", "ascending")])
            ids, labels, q, own = right.column("id").to_numpy(), right.column("label").to_numpy(), _matrix(right), _matrix(left)
            reach, packs = _reach(own), {}
            for key, label, h, anchor in zip(*(left.column(c).to_pylist() for c in ("id", "label", "h")), own.tolist()):
                lo, hi = np.searchsorted(labels, label, "left"), np.searchsorted(labels, label, "right")
                if lo == hi:
                    continue
                if label not in packs:
                    packs[label] = Packed(q[lo:hi], reach)
                score = packs[label].scores(anchor)
                other = np.flatnonzero(ids[lo:hi] != key)
                best = other[np.argsort(-score[other], kind="stable")[:n]]
                out += [(key, h, i, s) for i, s in zip(ids[lo + best].tolist(), score[best].tolist())]
        return _table(out, ("anchor_id", "h", "positive_id", "positive_score"))

    found = _met(anchors, rows, _block_counts(anchors, rows), run, _FOUND)
    return _first(found, ["anchor_id", "h"], "positive_score", "positive_id", n)


def mine(df: DataFrame, anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of the prepared rows.

    `anchor` tells the anchors.  Negatives have another label and at least four fifths of the
    positive's score, but not more than it; the first come by descending score, ties by id."""
    rows = stored(df)
    anchors = rows.where(anchor)
    known = stored(nearest_alike(anchors, rows, positives))
    lists = known.groupBy(F.col("anchor_id").alias("id"), "h").agg(F.collect_list(F.struct("positive_id", "positive_score")).alias("ps"))
    asking = stored(anchors.join(lists, ["id", "h"]))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if left.num_rows and right.num_rows:
            right = right.sort_by("id")
            ids, labels, own = right.column("id").to_numpy(), right.column("label").to_numpy(), _matrix(left)
            packed = Packed(_matrix(right), _reach(own))
            for key, label, h, ps, q in zip(*(left.column(c).to_pylist() for c in ("id", "label", "h", "ps")), own.tolist()):
                other = np.flatnonzero(labels != label)
                score = packed.scores(q)[other]
                order = np.argsort(-score, kind="stable")
                falling = -score[order]
                for p in ps:
                    top = p["positive_score"]
                    least = top - top // 5  # the smallest integer of four fifths
                    start = int(np.searchsorted(falling, -top, "left"))
                    for spot in range(start, min(start + negatives, len(order))):
                        if -int(falling[spot]) < least:
                            break
                        out.append((key, h, p["positive_id"], top, int(ids[other[order[spot]]]), -int(falling[spot])))
        return _table(out, ("anchor_id", "h", "positive_id", "positive_score", "negative_id", "negative_score"))

    found = _met(asking, rows, _block_counts(asking, rows), run, f"{_FOUND}, negative_id long, negative_score long")
    return _first(found, ["anchor_id", "h", "positive_id", "positive_score"], "negative_score", "negative_id", negatives).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def _table(rows: list[tuple], names: tuple[str, ...]) -> pa.Table:
    columns = list(zip(*rows)) if rows else [()] * len(names)
    return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(names, columns)})


_SQL = """WITH v AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.id AS anchor_id, v.id, v.label = a.label AS alike, CAST(list_dot_product(a.q, v.q) AS BIGINT) AS score
  FROM v AS a JOIN v ON a.id <> v.id WHERE a.id % 100 = 0),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE alike
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
n AS (SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS rank, id AS negative_id,
    positive_score, score AS negative_score FROM p JOIN s USING (anchor_id)
  WHERE NOT alike AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5"""


@query("op11_packed_negatives", _SQL)
def op11_packed_negatives(spark, sf_dir):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(prepared(table(spark, sf_dir, "embeddings"), label=label), F.col("id") % 100 == 0)
