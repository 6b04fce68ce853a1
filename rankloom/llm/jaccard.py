"""N-gram Jaccard join: links of texts whose five-word shingle sets are alike, and their components.

Vertical partitioning.  Shingles have a global order, that of their 48-bit hashes, and it is cut into
fragments, each a range of hashes.  Three steps use it:

1. `fragments`: tasks hash their texts and send every fragment the part of each set that lies in
   it, packed to about five bytes an n-gram.  A fragment counts in how many sets each of its n-grams
   lies and sends those in two or more back to the task's batch, with the count.
2. A set with fewer than 80 % of such n-grams has no partner, and is done.  The others put their
   n-grams in the order (count, hash); two alike sets must share one of the first n - ceil(0.8 n) + 1,
   at positions that leave enough behind.
3. Of the candidate pairs, partial overlaps are counted in each fragment separately and summed per pair.

Equal sets are one class and joined once.  Groups are not expanded into pairs: first, every class is
compared with one pivot of each list only; classes of one component need no further comparison.
What remains, pairs of different components that share a list, is compared in full, so no link
between components is lost.

Hot n-grams: one that lies in HOT sets or more of a batch is not sent entry by entry; the fragment
gets a mark, and its count is "hot" for everyone, so a fragment has at most HOT entries per n-gram and
batch.  Sets of up to millions of n-grams are handled whole.

Null and empty texts have an empty set, link with nothing and are their own component.  Texts of
fewer than five words have one shingle, the whole sequence.  Repeated rows of one doc_id are one
document with that id.  Extra columns are ignored.  An empty table gives an empty result."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, functions as F

from rankloom.llm import graph
from rankloom.llm.common import group_count, shingle_hashes, slices, stored, strings, words_of
from rankloom.llm.registry import query, table

# Least similarity, in percent.
PERCENT = 80
# Bits of a hash, and sets and n-grams of a batch at most (a longer set is a batch of its own).
BITS, BATCH_SETS, BATCH_GRAMS = 48, 60_000, 2_000_000
# Fragments (a power of two) in which the overlaps of candidate pairs are counted.
PARTS = 4
# Turns in which sets are compared with a pivot of their lists only.
TURNS = 3
# Stands for a null doc_id.
NO_ID = (1 << 63) - 1
# Sets of one batch that make an n-gram hot; MARK is the set number that stands for them.
HOT, MARK, HOT_COUNT = 256, 65_535, 65_535

_CUT = "f int, kind int, batch long, doc_id long, n long, hi long, lo long, grams binary, counts binary"
_DOC, _SINGLE, _DIRECT = 0, 1, 2
_NAMES = ["f", "kind", "batch", "doc_id", "n", "hi", "lo", "grams", "counts"]


def pack(values: np.ndarray) -> bytes:
    """Sorted 64-bit numbers as compressed planes of the bytes of their differences."""
    steps = np.diff(values, prepend=np.uint64(0)).astype("<u8")
    return zstandard.ZstdCompressor(level=1).compress(steps.view(np.uint8).reshape(-1, 8).T.tobytes())


def unpack(data: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8)
    return np.cumsum(np.ascontiguousarray(raw.reshape(8, -1).T).view("<u8").ravel(), dtype=np.uint64)


def grams_of(text: str) -> np.ndarray:
    """The set of a text: sorted distinct 48-bit hashes of its shingles."""
    return np.unique(shingle_hashes(words_of(text)) >> np.uint64(64 - BITS))


def _rows(**columns) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(columns.get(c, [None] * n), k) for c, k in zip(_NAMES, kinds)], names=_NAMES)


def _cut(fragments: int):
    """Texts to document rows and to packed parts of their sets, by fragment."""
    width = -(-(1 << BITS) // fragments)

    def flush(batch: int, docs: list, sets: list[np.ndarray]):
        # documents carry the number of their set in the batch in `lo`'s place of the key columns below
        order = sorted(range(len(docs)), key=lambda i: docs[i][0])
        number, kept = {}, []
        for i in order:
            digest = docs[i][2]
            if digest not in number:
                number[digest] = len(kept)
                kept.append(i)
        first = set(kept)
        yield _rows(f=[int(d[0]) % fragments for d in docs], kind=[_DOC] * len(docs), batch=[batch] * len(docs), doc_id=[d[0] for d in docs],
                    n=[d[1] for d in docs], hi=[d[2][0] for d in docs], lo=[d[2][1] for d in docs],
                    grams=[number[d[2]].to_bytes(2, "little") if i in first else None for i, d in enumerate(docs)])
        parts = [(sets[i] << np.uint64(16)) | np.uint64(number[docs[i][2]]) for i in kept if len(sets[i])]
        if not parts:
            return
        entries = np.concatenate(parts)
        entries.sort()
        keys = entries >> np.uint64(16)
        starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        sizes = np.diff(np.append(starts, len(keys)))
        hot = np.repeat(sizes >= HOT, sizes)
        if hot.any():
            direct = entries[hot]
            yield _rows(f=[batch % fragments], kind=[_DIRECT], batch=[batch], grams=[pack(direct)],
                        counts=[np.full(len(direct), HOT_COUNT, "<u2").tobytes()])
            marks = (np.unique(direct >> np.uint64(16)) << np.uint64(16)) | np.uint64(MARK)
            entries = np.sort(np.concatenate((entries[~hot], marks)))
        ends = np.searchsorted(entries >> np.uint64(16), np.arange(1, fragments + 1, dtype=np.uint64) * np.uint64(width))
        begins = np.concatenate(([0], ends[:-1]))
        used = np.flatnonzero(ends > begins)
        yield _rows(f=used.tolist(), kind=[_SINGLE] * len(used), batch=[batch] * len(used),
                    grams=[pack(entries[begins[u]:ends[u]]) for u in used])

    def run(batches):
        from pyspark import TaskContext
        task, number = TaskContext.get().partitionId(), 0
        docs, sets, size = [], [], 0
        for part in slices(batches, "text"):
            for doc_id, text in zip(part.column("doc_id").to_pylist(), strings(part.column("text"))):
                grams = grams_of(text)
                if docs and (size + len(grams) > BATCH_GRAMS or len(docs) >= BATCH_SETS):
                    yield from flush((task << 24) + number, docs, sets)
                    docs, sets, size, number = [], [], 0, number + 1
                digest = xxhash.xxh3_128_intdigest(grams.tobytes())
                docs.append((doc_id, len(grams), ((digest >> 64) - (1 << 63), (digest & ((1 << 64) - 1)) - (1 << 63))))
                sets.append(grams)
                size += len(grams)
        if docs:
            yield from flush((task << 24) + number, docs, sets)

    return run


def _count(data: pa.Table) -> pa.Table:
    """One fragment: n-grams of two or more sets go back to their batches, with the count."""
    kinds = data.column("kind").to_numpy()
    out = [data.filter(pa.array(kinds != _SINGLE))]
    single = data.filter(pa.array(kinds == _SINGLE))
    if len(single):
        blobs = [unpack(b) for b in single.column("grams").to_pylist()]
        which = np.repeat(np.arange(len(blobs)), [len(b) for b in blobs])
        entries = np.concatenate(blobs)
        keys = entries >> np.uint64(16)
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        sizes = np.diff(np.append(starts, len(keys)))
        marked = np.logical_or.reduceat((entries[order] & np.uint64(0xFFFF)) == np.uint64(MARK), starts)
        count = np.empty(len(keys), dtype=np.int64)
        count[order] = np.repeat(np.where(marked, HOT_COUNT, np.minimum(sizes, HOT_COUNT - 1)), sizes)
        keep = (count >= 2) & ((entries & np.uint64(0xFFFF)) != np.uint64(MARK))
        entries, count, which = entries[keep], count[keep], which[keep]
        ends = np.searchsorted(which, np.arange(len(blobs)), side="right")
        begins = np.concatenate(([0], ends[:-1]))
        batches = single.column("batch").to_pylist()
        used = [i for i in range(len(blobs)) if ends[i] > begins[i]]
        out.append(pa.Table.from_batches([_rows(
            f=[0] * len(used), kind=[_SINGLE] * len(used), batch=[batches[i] for i in used], grams=[pack(entries[begins[i]:ends[i]]) for i in used],
            counts=[zstandard.compress(count[begins[i]:ends[i]].astype("<u2").tobytes(), 1) for i in used])]))
    return pa.concat_tables([t.select(_NAMES).cast(_rows(f=[]).schema) for t in out])


_SETS = "doc_id long, n long, hi long, lo long, alone int, first array<bigint>, grams array<binary>"


def _sets(data: pa.Table) -> pa.Table:
    """One batch: a row per document; sets that may have a partner come with their shared n-grams in order."""
    kinds = data.column("kind").to_numpy()
    docs = data.filter(pa.array(kinds == _DOC))
    rest = data.filter(pa.array(kinds != _DOC))
    shared: dict[int, np.ndarray] = {}
    if len(rest):
        blobs, counts = [], []
        for kind, grams, count in zip(rest.column("kind").to_pylist(), rest.column("grams").to_pylist(), rest.column("counts").to_pylist()):
            blobs.append(unpack(grams))
            counts.append(np.frombuffer(count if kind == _DIRECT else zstandard.decompress(count), dtype="<u2"))
        entries, count = np.concatenate(blobs), np.concatenate(counts).astype(np.uint64)
        # sort by set, count and hash in one pass over two keys
        number = entries & np.uint64(0xFFFF)
        order = np.lexsort((entries >> np.uint64(16), (number << np.uint64(16)) | count))
        number, keys = number[order], (entries >> np.uint64(16))[order].astype(np.int64)
        cuts = np.flatnonzero(np.concatenate(([True], number[1:] != number[:-1])))
        for a, b in zip(cuts, np.append(cuts[1:], len(number))):
            shared[int(number[a])] = keys[a:b]
    rows = {n: [] for n in ("alone", "first", "grams")}
    for n, number in zip(docs.column("n").to_pylist(), docs.column("grams").to_pylist()):
        own = shared.get(int.from_bytes(number, "little")) if number is not None and n else None
        need = -(-PERCENT * n // 100)
        if own is None or len(own) < need:
            for values in rows.values():
                values.append(None)
            continue
        alone = n - len(own)
        rows["alone"].append(alone)
        rows["first"].append(own[:n - need + 1 - alone])
        own = np.sort(own).astype(np.uint64)
        cuts = np.searchsorted(own, np.arange(1, PARTS, dtype=np.uint64) << np.uint64(BITS - PARTS.bit_length() + 1))
        rows["grams"].append([pack(part) for part in np.split(own, cuts)])
    return pa.Table.from_arrays(
        [docs.column(c).combine_chunks() if len(docs) else pa.array([], pa.int64()) for c in ("doc_id", "n", "hi", "lo")]
        + [pa.array(rows["alone"], pa.int32()), pa.array(rows["first"], pa.list_(pa.int64())), pa.array(rows["grams"], pa.list_(pa.binary()))],
        names=["doc_id", "n", "hi", "lo", "alone", "first", "grams"])


def shared_sets(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: n, the class of its set (hi, lo) and, where a partner is possible, `grams` (those
    that lie in other sets too, packed by fragment), how many others it has (`alone`), and `first`:
    the n-grams, in ascending count and hash, one of which a partner must have among its own first."""
    # a null id stands last, so that it names a component only if all its ids are null
    rows = df.select(F.coalesce(F.col(doc_id).cast("bigint"), F.lit(NO_ID)).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    cut = rows.mapInArrow(_cut(group_count(df)), _CUT)
    counted = cut.groupBy("f").applyInArrow(_count, _CUT)
    return counted.groupBy("batch").applyInArrow(_sets, _SETS)


def _overlaps(batches):
    """Partial overlaps of pairs, one per fragment."""
    for batch in batches:
        counts = [[len(np.intersect1d(unpack(a), unpack(b), assume_unique=True)) for a, b in zip(x, y)]
                  for x, y in zip(batch.column("grams_x").to_pylist(), batch.column("grams_y").to_pylist())]
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("x", "y", "n")], pa.array(counts, pa.list_(pa.int64()))],
                                         names=["x", "y", "n", "common"])


def _verified(pairs: DataFrame, heads: DataFrame, parts: DataFrame) -> DataFrame:
    """Pairs (x, y) that are links, with the size of the intersection, from partial overlaps.

    What two sets share up to the end of one's first n-grams lies among the first of both; what comes
    after is at most the rest of that set.  So alike sets share more than one of their first n-grams,
    the more the closer their sizes are, and pairs with fewer are not counted out."""
    head = lambda end: heads.select(F.col("node").alias(end), F.col("n").alias(f"n_{end}"), F.col("first").alias(f"first_{end}"))
    enough = F.expr(f"size(array_intersect(first_x, first_z)) + ceil({PERCENT} * greatest(n_x, n_z) / 100) - 1 >= "
                    f"ceil({PERCENT} * (n_x + n_z) / {100 + PERCENT})")
    near = pairs.select("x", "y").join(head("x"), "x")
    pairs = near.join(head("z"), F.expr("y = z") & enough).select("x", "y")
    of = lambda end: parts.select(F.col("node").alias(end), F.col("grams").alias(f"grams_{end}"), F.col("n").alias(f"n_{end}"))
    both = pairs.select("x", "y").join(of("x"), "x").join(of("y"), "y")
    counts = both.select("x", "y", (F.col("n_x") + F.col("n_y")).alias("n"), "grams_x", "grams_y").mapInArrow(
        _overlaps, "x long, y long, n long, common array<bigint>")
    whole = F.aggregate("common", F.lit(0).cast("bigint"), lambda total, part: total + part)
    return counts.select("x", "y", "n", whole.alias("common")).where(
        100 * F.col("common") >= PERCENT * (F.col("n") - F.col("common"))).select("x", "y", "common")


# Two sets of a list can only be alike if sizes and what follows the shared n-gram allow it.
_POSSIBLE = (f"100 * least(a.n, b.n) >= {PERCENT} * greatest(a.n, b.n) AND "
             f"{100 + PERCENT} * least(a.behind, b.behind) >= {PERCENT} * (a.n + b.n)")


class _Candidates:
    """Lists of the sets that share one of their first n-grams."""

    def __init__(self, sets: DataFrame, nodes: DataFrame):
        alive = sets.where("grams IS NOT NULL").join(nodes, "doc_id", "left_semi")
        alive = stored(alive.select(F.col("doc_id").alias("node"), "n", "alone", "first", "grams"))
        self.heads = alive.select("node", "n", "first")
        self.parts = alive.select("node", "n", "grams")
        entries = alive.select("node", "n", "alone", F.posexplode("first").alias("at", "gram"))
        entries = entries.select("gram", "node", "n", (F.col("n") - F.col("alone") - F.col("at")).alias("behind"))
        lists = entries.groupBy("gram").agg(F.count("*").alias("size")).where("size > 1").select("gram")
        self.entries = stored(entries.join(lists, "gram"))

    def pairs(self, labels: DataFrame | None = None) -> DataFrame:
        """All possible pairs; with labels (node, component), those of different components."""
        e = self.entries
        condition = "a.gram = b.gram AND a.node < b.node AND " + _POSSIBLE
        if labels is not None:
            e = self._labelled(labels)
            mixed = e.groupBy("gram").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("gram")
            e = stored(e.join(mixed, "gram", "left_semi"))
            condition += " AND a.component <> b.component"
        return e.alias("a").join(e.alias("b"), F.expr(condition)).select(F.col("a.node").alias("x"), F.col("b.node").alias("y")).distinct()

    def spokes(self, labels: DataFrame, turn: int) -> DataFrame:
        """At most one pair per set: with the pivot, of another component, that most of its lists have.

        The first turn's pivots are the sets with the smallest share of n-grams of their own."""
        e = self._labelled(labels)
        rank = F.struct((F.col("behind") / F.col("n")).alias("share"), F.xxhash64("node").alias("h")) if turn == 0 else F.xxhash64("node", F.lit(turn))
        pivots = e.groupBy("gram").agg(F.max_by(F.struct("node", "n", "behind", "component"), rank).alias("b"))
        a = e.join(pivots, "gram").withColumn("a", F.struct("n", "behind")).where(F.col("component") != F.col("b.component")).where(_POSSIBLE)
        best = a.groupBy("node", F.col("b.node").alias("pivot")).agg(F.count("*").alias("lists"))
        chosen = best.groupBy("node").agg(F.max_by("pivot", F.struct("lists", "pivot")).alias("pivot"))
        return chosen.select(F.least("node", "pivot").alias("x"), F.greatest("node", "pivot").alias("y")).distinct()

    def _labelled(self, labels: DataFrame) -> DataFrame:
        return self.entries.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))


def classes(sets: DataFrame) -> DataFrame:
    """(hi, lo, node): the smallest doc_id of each class of equal, non-empty sets."""
    return sets.where("n > 0").groupBy("hi", "lo").agg(F.min("doc_id").alias("node"))


def links(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """All links, between class representatives (x, y, common), and the membership (doc_id, n, node)."""
    sets = stored(shared_sets(df, doc_id, text))
    nodes = classes(sets)
    found = _Candidates(sets, nodes.select(F.col("node").alias("doc_id")))
    members = sets.select("doc_id", "n", "hi", "lo").join(nodes, ["hi", "lo"], "left")
    return _verified(found.pairs(), found.heads, found.parts), members.select(_id("doc_id"), "n", _id("node"))


def _id(name: str):
    return F.when(F.col(name) != NO_ID, F.col(name)).alias(name)


def components(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document."""
    sets = stored(shared_sets(df, doc_id, text))
    nodes = stored(classes(sets))
    found = _Candidates(sets, nodes.select(F.col("node").alias("doc_id")))
    labels = stored(found.entries.select("node").distinct().withColumn("component", F.col("node")))
    turn = 0
    while turn <= TURNS:
        pairs = found.spokes(labels, turn) if turn < TURNS else found.pairs(labels)
        of = lambda end: labels.select(F.col("node").alias(end), F.col("component").alias(f"of_{end}"))
        new = stored(_verified(pairs, found.heads, found.parts).join(of("x"), "x").join(of("y"), "y").select("of_x", "of_y"))
        if not new.isEmpty():
            merged = graph.components(new, "of_x", "of_y").select(F.col("node").alias("component"), F.col("component").alias("into"))
            labels = stored(labels.join(merged, "component", "left").select("node", F.coalesce("into", "component").alias("component")))
            turn += 1
        else:
            turn = TURNS if turn < TURNS else TURNS + 1
    members = sets.select("doc_id", "n", "hi", "lo").join(nodes, ["hi", "lo"], "left").join(labels, "node", "left")
    return members.select(_id("doc_id"), F.col("n").alias("n_shingles"),
                          F.when(F.coalesce("component", "node", "doc_id") != NO_ID, F.coalesce("component", "node", "doc_id")).alias("component_id"))


@query("op10_jaccard_join")
def op10_jaccard_join(spark, sf_dir):
    return components(table(spark, sf_dir, "documents"))
