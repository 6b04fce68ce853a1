"""Benchmark decontamination: training passages as queries to a BM25 index of test items.

The index holds, per term, the items it is in with the weight it gives them: its BM25 share of the
item's own score, so a passage with all words of an item scores 1.  Postings lie in flat arrays, in blocks
with the largest weight of each.  An item's passages are windows of PASSAGE words, doubled until the
item fits, one every quarter of that; items of one window share an index, so that what is found of an
item does not depend on the others' lengths.  Every document is cut into the passages of each index,
and every passage asks for all items that score THRESHOLD or more, by block-max WAND: terms in order
of their next item, a pivot where the sum of their largest weights reaches the threshold, the sum of
the blocks' largest weights as a second test, then the exact score.

Most text can't reach the threshold at all.  So before passages are cut, stretches of text are bounded
for all items at once: the weights of a stretch's distinct rare terms, plus all that common terms can
add to the item, are no less than any of its passages' scores.  Common terms are made rare, those in
the fewest items first, until no item reaches the threshold by common terms alone.  Passages of
stretches whose bounds stay below are skipped; the result is the same.

A retrieved item counts if both its question (all sentences but the last; of a single sentence the
first half) and its answer (the rest) have half of their three-word runs or more in the passage.
Words are runs of other characters than ASCII white space and punctuation, with A-Z in lower case.

Null and empty texts have no passages, items without a word are never found.  Items with equal text
are indexed once and each found.  Null ids and repeated rows stay as they are; extra columns are ignored; an empty
table gives no rows.  Texts are read whole.  An index has some INDEX_POSTINGS postings at most; more
items of a window are split by the hash of their text into several indexes.  All indexes are used one
after the other, with common statistics, and any split of them finds the same."""

from __future__ import annotations

import math
import re
import string
from collections import Counter
from itertools import repeat
from typing import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from rankloom.llm.common import slices, stored, strings
from rankloom.llm.registry import query, table

K1, B = 1.2, 0.75
# Least score, as a share of the item's own, and least overlap of question and answer.
THRESHOLD, OVERLAP = 0.6, 0.5
# Words of the runs that are compared, of a passage at least, and postings of a block.
RUN, PASSAGE, BLOCK = 3, 64, 32
# A term is common if it is in more items than this share (and at least this number).
COMMON_SHARE, COMMON_ITEMS = 0.02, 3
INDEX_POSTINGS = 4_000_000

_CLEAN = bytes.maketrans(string.ascii_uppercase.encode() + string.punctuation.encode(),
                         string.ascii_lowercase.encode() + b" " * len(string.punctuation))


def terms_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_CLEAN).split()


def halves(text: str) -> tuple[list[bytes], list[bytes]]:
    """Words of the question and of the answer."""
    sentences = [w for w in map(terms_of, re.split(r"(?<=[.!?])\s+", text, flags=re.ASCII)) if w]
    if len(sentences) > 1:
        return [w for s in sentences[:-1] for w in s], sentences[-1]
    words = sentences[0] if sentences else []
    cut = (len(words) + 1) // 2
    return words[:cut], words[cut:]


def runs(words: list[bytes]) -> set[tuple[bytes, ...]]:
    size = min(RUN, len(words))
    return {tuple(words[i:i + size]) for i in range(len(words) - size + 1)} if size else set()


def window_of(words: int) -> int:
    """Words of an item's passages: PASSAGE, doubled until the item fits."""
    return PASSAGE << max(0, math.ceil(math.log2(words / PASSAGE))) if words > PASSAGE else PASSAGE


class Rows:
    """Rows of unlike lengths in one flat array."""

    def __init__(self, flat: np.ndarray, sizes: np.ndarray):
        self.flat, self.starts = flat, np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))

    @classmethod
    def of(cls, rows: Iterable[list[int]]) -> Rows:
        rows = list(rows)
        return cls(np.fromiter((v for r in rows for v in r), dtype=np.int32), np.array([len(r) for r in rows], dtype=np.int64))

    def __len__(self) -> int:
        return len(self.starts) - 1

    def __getitem__(self, i: int) -> memoryview:
        return memoryview(self.flat)[self.starts[i]:self.starts[i + 1]]


class Runs:
    """The word runs of every item, made when one is asked for."""

    def __init__(self, words: Rows, names: list[bytes]):
        self.words, self.names = words, names

    def __getitem__(self, item: int) -> set[tuple[bytes, ...]]:
        return runs([self.names[t] for t in self.words[item]])


class Index:
    """Inverted index of test items: (item_id, text) pairs, with the statistics of all items."""

    def __init__(self, items: list[tuple[int, str]], frequency: dict[bytes, int], n: int, mean_length: float, threshold: float = THRESHOLD):
        equal: dict[str, list[int]] = {}
        for i, t in items:
            equal.setdefault(t, []).append(i)
        self.ids = list(equal.values())
        self.terms: dict[bytes, int] = {}
        longest = 0
        idf = {t: math.log(1 + (n - d + 0.5) / (d + 0.5)) for t, d in frequency.items()}
        questions, answers, of_item, of_weight = [], [], [], []
        for text in equal:
            words = terms_of(text)
            longest = max(longest, len(words))
            count = Counter(words)
            weight = np.array([idf[t] * f * (K1 + 1) / (f + K1 * (1 - B + B * len(words) / mean_length)) for t, f in count.items()])
            of_item.append(np.array([self.terms.setdefault(t, len(self.terms)) for t in count], dtype=np.int32))
            of_weight.append(weight / sum(weight.tolist()))
            question, answer = halves(text)
            questions.append([self.terms[t] for t in question])
            answers.append([self.terms[t] for t in answer])
        names = list(self.terms)
        self.question, self.answer = Runs(Rows.of(questions), names), Runs(Rows.of(answers), names)
        self.window = window_of(longest)
        term = np.concatenate([np.empty(0, dtype=np.int32), *of_item])
        item = np.repeat(np.arange(len(of_item), dtype=np.int32), [len(t) for t in of_item])
        order = np.argsort(term, kind="stable")
        sizes = np.bincount(term, minlength=len(names))
        self.items = Rows(item[order], sizes)
        self.weights = Rows(np.concatenate([np.empty(0), *of_weight])[order], sizes)
        per_term = -(-sizes // BLOCK)
        block = np.arange(per_term.sum()) - np.repeat(np.cumsum(per_term) - per_term, per_term)
        first = np.repeat(self.items.starts[:-1], per_term) + BLOCK * block
        self.blocks = Rows(np.maximum.reduceat(self.weights.flat, first) if len(first) else np.empty(0), per_term)
        self.largest = np.maximum.reduceat(self.weights.flat, self.items.starts[:-1]) if len(names) else np.empty(0)
        self.bound_by(threshold)

    def bound_by(self, threshold: float) -> None:
        """Choose the rare terms, so that no item reaches the threshold without one."""
        self.threshold = threshold
        sizes = np.diff(self.items.starts)
        self.rare = sizes <= max(COMMON_ITEMS, COMMON_SHARE * len(self.ids))
        # what common terms can add to each item
        common = np.repeat(~self.rare, sizes)
        self.rest = np.bincount(self.items.flat[common], self.weights.flat[common], minlength=len(self.ids))
        for t in sorted(np.flatnonzero(~self.rare).tolist(), key=lambda t: (sizes[t], t)):
            over = self.rest >= threshold - 1e-6
            if not over.any():
                break
            its = np.asarray(self.items[t])
            if over[its].any():
                self.rare[t] = True
                self.rest[its] -= np.asarray(self.weights[t])

    def hopeful(self, ids: np.ndarray, stretch: np.ndarray, threshold: float) -> np.ndarray:
        """The stretches (numbers) in which some item may reach the threshold."""
        key = np.unique(stretch * len(self.terms) + ids)
        stretch, ids = np.divmod(key, len(self.terms))
        starts = self.items.starts
        sizes = starts[ids + 1] - starts[ids]
        total = int(sizes.sum())
        if not total:
            return np.empty(0, dtype=np.int64)
        at = np.repeat(starts[ids] - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes) + np.arange(total)
        pair = np.repeat(stretch, sizes) * len(self.ids) + self.items.flat[at]
        order = np.argsort(pair, kind="stable")
        pair = pair[order]
        first = np.flatnonzero(np.concatenate(([True], pair[1:] != pair[:-1])))
        bound = np.add.reduceat(self.weights.flat[at[order]], first) + self.rest[pair[first] % len(self.ids)]
        return np.unique(pair[first][bound >= threshold - 1e-9] // len(self.ids))

    def search(self, terms: list[int], threshold: float) -> list[tuple[int, float]]:
        """All items that score `threshold` or more for the distinct terms: block-max WAND."""
        found = []
        end = len(self.ids)
        # next item, term, place in its postings, their items, weights and blocks, the largest weight
        cursors = [[self.items[t][0], t, 0, self.items[t], self.weights[t], self.blocks[t], float(self.largest[t])] for t in terms]
        while True:
            cursors = [c for c in cursors if c[0] < end]
            cursors.sort()
            bound, pivot = 0.0, -1
            for i, c in enumerate(cursors):
                bound += c[6]
                if bound >= threshold - 1e-9:
                    pivot = i
                    break
            if pivot < 0:
                return found
            item = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == item:
                pivot += 1
            # blocks that may hold the item, and the least item beyond one of them
            bound, beyond = 0.0, end
            for c in cursors[:pivot + 1]:
                posting, place = c[3], c[2]
                block = place // BLOCK
                while (block + 1) * BLOCK < len(posting) and posting[(block + 1) * BLOCK - 1] < item:
                    block += 1
                bound += c[5][block]
                last = posting[min((block + 1) * BLOCK, len(posting)) - 1]
                beyond = min(beyond, last + 1)
            if bound < threshold - 1e-9:
                after = cursors[pivot + 1][0] if pivot + 1 < len(cursors) else end
                target = max(item + 1, min(beyond, after))
                for c in cursors[:pivot + 1]:
                    self._seek(c, target)
                continue
            score = 0.0
            for c in cursors[:pivot + 1]:
                self._seek(c, item)
                if c[0] == item:
                    score += c[4][c[2]]
                    self._seek(c, item + 1)
            if score >= threshold - 1e-9:
                found.append((item, score))

    def _seek(self, cursor: list, target: int) -> None:
        posting, place = cursor[3], cursor[2]
        while place < len(posting) and posting[place] < target:
            # whole blocks at a time where they end before the target
            place = place + BLOCK if place % BLOCK == 0 and place + BLOCK <= len(posting) and posting[place + BLOCK - 1] < target else place + 1
        cursor[2] = place
        cursor[0] = posting[place] if place < len(posting) else len(self.ids)

    def matches(self, texts: list[str], threshold: float, overlap: float):
        """(row, item, score, question overlap, answer overlap, first word, last word) of each find."""
        if threshold < self.threshold:
            self.bound_by(threshold)
        window, step = self.window, max(1, self.window // 4)
        stride = 4 * window
        words = [terms_of(t) for t in texts]
        ids = [np.fromiter(map(self.terms.get, w, repeat(-1)), dtype=np.int64, count=len(w)) for w in words]
        sizes = np.array([len(w) for w in words])
        per_row = sizes // stride + 1
        base = np.concatenate(([0], np.cumsum(per_row)))
        flat = np.concatenate(ids) if ids else np.empty(0, dtype=np.int64)
        row = np.repeat(np.arange(len(words)), sizes)
        spot = np.arange(len(flat)) - np.repeat(np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes)
        known = (flat >= 0) & self.rare[flat]  # only rare terms enter the bounds one by one
        flat, row, spot = flat[known], row[known], spot[known]
        # stretch s of a row covers words [s * stride, (s + 1) * stride + window)
        own = base[row] + spot // stride
        also = (spot % stride < window) & (spot >= stride)
        hopeful = self.hopeful(np.concatenate((flat, flat[also])), np.concatenate((own, own[also] - 1)), threshold)
        best: dict[tuple[int, int], tuple] = {}
        for s in hopeful.tolist():
            r = int(np.searchsorted(base, s, side="right")) - 1
            first = (s - int(base[r])) * stride
            for start in range(first, min(first + stride, max(1, len(words[r]))), step):
                query_ids = sorted({t for t in ids[r][start:start + window].tolist() if t >= 0})
                for item, score in self.search(query_ids, threshold):
                    # the text that is compared reaches a step to both sides, as an item may begin between two passages
                    low, high = max(0, start - step), start + window + step
                    there = runs_of_all(words[r][low:high])
                    q, a = (share(part[item], there) for part in (self.question, self.answer))
                    if q >= overlap and a >= overlap and ((r, item) not in best or score > best[r, item][2]):
                        best[r, item] = (r, item, score, q, a, start, min(start + window, len(words[r])))
        return [(r, i, *rest) for r, item, *rest in best.values() for i in self.ids[item]]


def runs_of_all(words: list[bytes]) -> set[tuple[bytes, ...]]:
    """Runs of one to RUN words."""
    return {tuple(words[i:i + n]) for n in range(1, RUN + 1) for i in range(len(words) - n + 1)}


def share(wanted: set, there: set) -> float:
    return len(wanted & there) / len(wanted) if wanted else 1.0


def indexes(benchmark: DataFrame, item_id: str = "item_id", text: str = "text", threshold: float = THRESHOLD):
    """The indexes of all items, one after the other: by window, and by hash of the text within one."""
    items = benchmark.select(F.col(item_id).cast("bigint").alias("item_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def measure(batches):
        for batch in batches:
            windows = [window_of(len(terms_of(t))) for t in batch.column("text").to_pylist()]
            yield batch.append_column("window", pa.array(windows, pa.int64()))

    def count(batches):
        for batch in batches:
            found: Counter = Counter()
            length: Counter = Counter()
            for t, w in zip(batch.column("text").to_pylist(), batch.column("window").to_pylist()):
                terms = terms_of(t)
                length[w] += len(terms)
                found.update((w, term) for term in {b"", *terms})  # the empty term counts the items
            keys = list(found)
            yield pa.RecordBatch.from_arrays(
                [pa.array([w for w, _ in keys], pa.int64()), pa.array([t for _, t in keys], pa.binary()), pa.array(found.values(), pa.int64()),
                 pa.array([0 if t else length[w] for w, t in keys], pa.int64())], names=["window", "term", "n", "length"])

    items = items.mapInArrow(measure, "item_id long, text string, window long")
    stats = stored(items.mapInArrow(count, "window long, term binary, n long, length long")
                   .groupBy("window", "term").agg(F.sum("n").alias("n"), F.sum("length").alias("length")))
    terms = stats.where(F.length("term") > 0).groupBy("term").agg(F.sum("n").alias("n"))
    # a row per window, of which there are as many as the longest item can be halved
    sizes = stats.groupBy("window").agg(F.sum(F.when(F.length("term") > 0, F.col("n"))).alias("postings"),
                                        F.sum(F.when(F.length("term") == 0, F.col("n"))).alias("n"), F.sum("length").alias("length"))
    windows = sorted(sizes.collect())
    total, length = sum(w["n"] for w in windows), sum(w["length"] for w in windows)
    for w in windows:
        shards = -(-(w["postings"] or 0) // INDEX_POSTINGS)
        for shard in range(shards):
            some = items.where((F.col("window") == w["window"]) & (F.pmod(F.xxhash64("text"), F.lit(shards)) == shard))
            rows = sorted((r["item_id"] is None, r["item_id"] or 0, r["text"]) for r in some.collect())
            rows = [(null, i, t) for null, i, t in rows if terms_of(t)]
            if not rows:
                continue
            mine = {t for *_, text_ in rows for t in terms_of(text_)}
            here = some.sparkSession.createDataFrame([(bytearray(t),) for t in mine], "term binary")
            # statistics of one index's terms only; with one index these are all terms
            wanted = terms if shards == len(windows) == 1 else terms.join(here, "term", "left_semi")
            frequency = {bytes(r["term"]): r["n"] for r in wanted.collect()}
            yield Index([(None if null else i, t) for null, i, t in rows], frequency, total, length / total, threshold)


_FOUND = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double, first_word long, end_word long"


def contaminated(df: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
                 threshold: float = THRESHOLD, overlap: float = OVERLAP) -> DataFrame:
    """A row per document and test item that it gives away, with the best passage."""
    rows = df.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    context = df.sparkSession.sparkContext
    found = df.sparkSession.createDataFrame([], _FOUND)

    def searcher(shared):
        def run(batches):
            for part in slices(batches, "text"):
                ids = part.column("doc_id").to_pylist()
                hits = shared.value.matches(strings(part.column("text")), threshold, overlap)
                columns = list(zip(*hits)) if hits else [[]] * 7
                yield pa.RecordBatch.from_arrays(
                    [pa.array([ids[r] for r in columns[0]], pa.int64()), pa.array(columns[1], pa.int64())]
                    + [pa.array(c, pa.float64()) for c in columns[2:5]] + [pa.array(c, pa.int64()) for c in columns[5:]],
                    names=["doc_id", "item_id", "score", "question_overlap", "answer_overlap", "first_word", "end_word"])
        return run

    for index in indexes(benchmark, item_id, text, threshold):
        found = found.unionByName(rows.mapInArrow(searcher(context.broadcast(index)), _FOUND))
    return found


def clean(df: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id",
          threshold: float = THRESHOLD, overlap: float = OVERLAP) -> DataFrame:
    """The rows whose text gives no test item away.  No row moves: each task filters its own."""

    def filter_by(shared):
        def run(batches):
            for part in slices(batches, text):
                bad = {hit[0] for hit in shared.value.matches(strings(part.column(text)), threshold, overlap)}
                yield part.filter(pa.array([r not in bad for r in range(part.num_rows)], pa.bool_()))
        return run

    for index in indexes(benchmark, item_id, threshold=threshold):
        df = df.mapInArrow(filter_by(df.sparkSession.sparkContext.broadcast(index)), df.schema)
    return df


@query("op3_bm25_decontamination")
def op3_bm25_decontamination(spark, sf_dir):
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
