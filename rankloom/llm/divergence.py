"""How the words of each source differ from those of its language, and from those of each other source.

Terms are runs of letters: A-Z and a-z, and every character outside ASCII; only A-Z are lower-cased.
A language keeps the V terms that at least LEAST_DOCS of its documents have.  A group (language,
source), and a language as a whole, gives each kept term p = 1 + floor(UNIT (count + 1) / (N + V)),
N being its occurrences of kept terms.  The divergence of p from q is floor((p - q)^2 / q).

1. Indexing in memory, in one pass: a task counts the terms of its documents by group until POSTINGS
   entries are held, then passes them on as a run: for every shard (a hash of the term) and language
   the terms in order, each with its postings (group, count) and number of documents.
2. The runs of a shard are merged by a heap into term frequencies; terms of too few documents go.
3. N and V are summed, and each shard streams its terms against them.  A pair of sources that both
   lack a term, or of which one lacks it, is not visited: a pair's sum starts as if neither had any
   term, each source adds what its own counts change against an absent other (by distinct counts, not
   by terms), and a term corrects the pairs that both have it.

All numbers are integers and exact; a count may reach 9 * 10^15.  Null text, lang and source are ''.
Groups without kept terms have N = 0 and take part; with V = 0 all their pairs have the value 0.
Ties rank by the item's UTF-8 bytes.  Repeated rows count each.  Empty tables give no rows.  Other
columns are not read."""

from __future__ import annotations

import heapq
from collections import Counter, defaultdict
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from rankloom import runtime
from rankloom.llm.common import stored, word_hashes
from rankloom.llm.registry import query, table

LEAST_DOCS = 3
UNIT = 1_000_000_000
TOP_TERMS = 200
# Entries (a term of a group) a task holds before it passes on a run.
POSTINGS = 1_000_000
# Input bytes per shard.
SHARD_BYTES = 32 * 1024 * 1024

# Pairs of sources summed at once.
CELLS = 4_000_000

# Bytes of terms as they are, A-Z in lower case, all others as a space.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

RUNS = "shard int, lang string, sources array<string>, terms array<binary>, docs array<bigint>, places array<int>, who array<int>, counts array<bigint>"
FREQUENCIES = "shard int, lang string, term string, sources array<string>, counts array<bigint>"


def terms_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_LETTERS).split() if text else []


class Block:
    """Postings of the documents read since the last run."""

    def __init__(self):
        self.counts: dict[tuple[str, str], Counter] = defaultdict(Counter)
        self.docs: dict[str, Counter] = defaultdict(Counter)

    def add(self, lang: str, source: str, text: str | None) -> None:
        terms = terms_of(text)
        self.counts[lang, source].update(terms)
        self.docs[lang].update(set(terms))

    def size(self) -> int:
        return sum(map(len, self.counts.values()))

    def runs(self, shards: int):
        """A batch for every language: one row for each shard, terms in order."""
        for lang, docs in self.docs.items():
            if not docs:
                continue
            sources = sorted(s for l, s in self.counts if l == lang)
            vocabulary = sorted(docs)
            number = dict(zip(vocabulary, range(len(vocabulary))))
            shard = (word_hashes(vocabulary) % np.uint64(shards)).astype(np.int64)
            own = [self.counts[lang, s] for s in sources]
            total = sum(map(len, own))
            who = np.repeat(np.arange(len(sources), dtype=np.int32), list(map(len, own)))
            term = np.fromiter((number[t] for c in own for t in c), np.int64, total)
            count = np.fromiter((n for c in own for n in c.values()), np.int64, total)
            postings = np.lexsort((who, term, shard[term]))
            terms = np.argsort(shard, kind="stable")
            places = np.bincount(term, minlength=len(vocabulary))[terms]
            first = np.flatnonzero(np.diff(shard[terms], prepend=-1))
            ends = np.concatenate(([0], np.cumsum(places)))
            by_term = pa.array([*first, len(terms)], pa.int32())
            by_posting = pa.array(ends[[*first, len(terms)]], pa.int32())
            listed = pa.ListArray.from_arrays
            yield pa.RecordBatch.from_arrays([
                pa.array(shard[terms][first], pa.int32()), pa.array([lang] * len(first), pa.string()), pa.array([sources] * len(first), pa.list_(pa.string())),
                listed(by_term, pa.array(vocabulary, pa.binary()).take(pa.array(terms))), listed(by_term, pa.array(np.fromiter(map(docs.__getitem__, vocabulary), np.int64)[terms])),
                listed(by_term, pa.array(places, pa.int32())), listed(by_posting, pa.array(who[postings])), listed(by_posting, pa.array(count[postings]))],
                names=["shard", "lang", "sources", "terms", "docs", "places", "who", "counts"])


def runs(docs: DataFrame, shards: int, lang: str = "lang", source: str = "source", text: str = "text", postings: int = POSTINGS) -> DataFrame:
    """The runs of all tasks."""

    def run(batches):
        block, fresh = Block(), 0
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "text"))):
                block.add(*row)
                fresh += 1 + len(row[2]) // 1024
                if fresh > 256:  # the size is looked at now and then
                    fresh = 0
                    if block.size() >= postings:
                        yield from block.runs(shards)
                        block = Block()
        yield from block.runs(shards)

    return _plain(docs, lang, source, text).mapInArrow(run, RUNS)


def _plain(docs: DataFrame, lang: str, source: str, *others: str) -> DataFrame:
    named = zip(("lang", "source", "text"), (lang, source, *others))
    return docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for n, c in named])


def _flat(data: pa.Table, column: str) -> pa.Array:
    return data.column(column).combine_chunks().flatten()


def _merged(data: pa.Table) -> pa.Table:
    """Term frequencies of one shard from its runs."""
    tables = []
    for lang in pc.unique(data.column("lang")):
        same = data.filter(pc.equal(data.column("lang"), lang))
        cursors = [zip(terms.as_py(), repeat(n)) for n, terms in enumerate(same.column("terms"))]
        merged: list[bytes] = []
        spots: list[list[int]] = [[] for _ in cursors]  # of each run's terms in the merged order
        last = None
        for term, n in heapq.merge(*cursors):
            if term != last:
                merged.append(term)
                last = term
            spots[n].append(len(merged) - 1)
        spot = np.concatenate([np.array(s, dtype=np.int64) for s in spots])
        docs = np.zeros(len(merged), dtype=np.int64)
        np.add.at(docs, spot, _flat(same, "docs").to_numpy())
        # a run's own numbers of sources become common ones
        names = pc.unique(_flat(same, "sources"))
        common = pc.index_in(_flat(same, "sources"), names).to_numpy()
        before = np.concatenate(([0], np.cumsum(pc.list_value_length(same.column("sources")).to_numpy())))[:-1]
        source = common[np.repeat(before, pc.list_value_length(same.column("who")).to_numpy()) + _flat(same, "who").to_numpy()]
        term = np.repeat(spot, _flat(same, "places").to_numpy())
        kept = docs[term] >= LEAST_DOCS
        key = term[kept] * len(names) + source[kept]
        order = np.argsort(key, kind="stable")
        starts = np.flatnonzero(np.diff(key[order], prepend=-1))
        if len(starts):
            counts = np.add.reduceat(_flat(same, "counts").to_numpy()[kept][order], starts)
            key = key[order][starts]
            who, term = pa.array(key % len(names)), key // len(names)
            first = np.flatnonzero(np.diff(term, prepend=-1))
            cuts = pa.array([*first, len(term)], pa.int32())
            words = pa.array([merged[i] for i in term[first].tolist()], pa.binary())
            tables.append(pa.table({"shard": pa.array(np.full(len(first), data.column("shard")[0].as_py()), pa.int32()), "lang": pa.array([lang.as_py()] * len(first), pa.string()),
                                    "term": words.cast(pa.string()), "sources": pa.ListArray.from_arrays(cuts, names.take(who)),
                                    "counts": pa.ListArray.from_arrays(cuts, pa.array(counts))}))
    schema = pa.schema([("shard", pa.int32()), ("lang", pa.string()), ("term", pa.string()), ("sources", pa.list_(pa.string())), ("counts", pa.list_(pa.int64()))])
    return pa.concat_tables([t.cast(schema) for t in tables]) if tables else schema.empty_table()


def shard_count(docs: DataFrame) -> int:
    scanned = sum(runtime._leaf_bytes(docs, scans_only=True))
    return max(-(-scanned // SHARD_BYTES), 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def frequencies(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", postings: int = POSTINGS) -> DataFrame:
    """(shard, lang, term, sources, counts) of every kept term."""
    return runs(docs, shard_count(docs), lang, source, text, postings).groupBy("shard").applyInArrow(_merged, FREQUENCIES)


def share(counts: np.ndarray, total: np.ndarray | int) -> np.ndarray:
    """1 + floor(UNIT (counts + 1) / total), by long division: no product is beyond 64 bits."""
    total = np.asarray(total, dtype=np.int64)
    whole, rest = np.divmod(np.asarray(counts, dtype=np.int64) + 1, total)
    for _ in range(3):
        step, rest = np.divmod(rest * 1000, total)
        whole = whole * 1000 + step
    return whole + 1


def gap(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


# What a shard adds to the pairs of a language, and the best terms of its groups.
_PARTS = "lang string, source string, part string, item string, value long"


def _pair_sums(absent: np.ndarray, totals: np.ndarray, own: np.ndarray, p: np.ndarray, counts: np.ndarray, places: np.ndarray):
    """(lo, hi, sums): divergences of the sources lo..hi from every source over the terms of a shard, CELLS numbers
    at a time.  own, p, counts are those of the postings by term and source, `places` a term's number of postings."""
    n, starts = len(absent), np.concatenate(([0], np.cumsum(places)))[:-1]
    order = np.lexsort((counts, own))
    edge = np.flatnonzero((np.diff(own[order], prepend=-1) != 0) | (np.diff(counts[order], prepend=0) != 0))
    alone, of, times = p[order][edge], own[order][edge], np.diff(np.concatenate((edge, [len(order)])))
    for lo in range(0, n, max(1, CELLS // n)):
        hi = min(n, lo + max(1, CELLS // n))
        base = gap(absent[lo:hi, None], absent[None, :])
        sums = len(places) * base
        for s in np.unique(of):
            for part in np.array_split(np.flatnonzero(of == s), -(-int((of == s).sum()) * n // CELLS)):
                t, q = times[part][:, None], alone[part][:, None]
                if lo <= s < hi:
                    sums[s - lo] += (t * (gap(q, absent[None, :]) - base[s - lo])).sum(axis=0)
                sums[:, s] += (t * (gap(absent[None, lo:hi], q) - base[:, s])).sum(axis=0)
        flat = sums.reshape(-1)
        for k in np.unique(places):
            some = np.flatnonzero(places == k)
            for part in np.array_split(some, -(-len(some) * int(k) * int(k) // CELLS)) if k > 1 else ():
                at = starts[part][:, None] + np.arange(k)
                a, b = own[at][:, :, None], own[at][:, None, :]
                pa_, pb, za, zb = p[at][:, :, None], p[at][:, None, :], absent[a], absent[b]
                # both have the term: instead of what each alone changes
                more = gap(pa_, pb) - gap(pa_, zb) - gap(za, pb) + gap(za, zb)
                here = np.broadcast_to((a >= lo) & (a < hi), more.shape)
                np.add.at(flat, ((a - lo) * n + b)[here], more[here])
        yield lo, hi, sums


def _streamed(key, freq: pa.Table, groups: pa.Table) -> pa.Table:
    """Partial sums of pairs and best terms of a language's part in one shard."""
    out: list[pa.Table] = []
    if freq.num_rows:
        freq = freq.sort_by("term")
        lang, sources = groups.column("lang")[0], groups.column("source").combine_chunks()
        v, n_all = groups.column("v")[0].as_py(), groups.column("n_lang")[0].as_py()
        totals = groups.column("n").to_numpy().astype(np.int64) + v
        places = pc.list_value_length(freq.column("counts")).to_numpy().astype(np.int64)
        own, counts = pc.index_in(_flat(freq, "sources"), sources).to_numpy().astype(np.int64), _flat(freq, "counts").to_numpy()
        term = np.repeat(np.arange(len(places)), places)
        order = np.lexsort((own, term))
        own, counts = own[order], counts[order]
        p = share(counts, totals[own])
        absent = share(np.zeros(len(totals), dtype=np.int64), totals)

        def add(part: str, a: np.ndarray, items: pa.Array, values: np.ndarray) -> None:
            out.append(pa.table({"lang": pa.array([lang.as_py()] * len(a), pa.string()), "source": sources.take(pa.array(a)),
                                 "part": pa.array([part] * len(a), pa.string()), "item": items, "value": pa.array(values, pa.int64())}))

        for lo, hi, sums in _pair_sums(absent, totals, own, p, counts, places):
            a, b = np.nonzero(sums)
            other = lo + a != b
            add("pair", lo + a[other], sources.take(pa.array(b[other])), sums[a[other], b[other]])
        starts = np.concatenate(([0], np.cumsum(places)))[:-1]
        q = share(np.add.reduceat(counts, starts), n_all + v)[term]
        more = np.flatnonzero(p > q)
        value = gap(p[more], q[more])
        order = np.lexsort((term[more], -value, own[more]))  # terms are in order
        more, value = more[order], value[order]
        first = np.flatnonzero(np.diff(own[more], prepend=-1))
        best = np.arange(len(more)) - np.repeat(first, np.diff(np.concatenate((first, [len(more)])))) < TOP_TERMS
        add("term", own[more][best], freq.column("term").combine_chunks().take(pa.array(term[more][best])), value[best])
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("part", pa.string()), ("item", pa.string()), ("value", pa.int64())])
    return pa.concat_tables([t.cast(schema) for t in out]) if out else schema.empty_table()


def audit(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", postings: int = POSTINGS) -> DataFrame:
    """(lang, source, part, item, value, rank): for each group the divergences from all other sources
    of its language (`pair`) and the terms it has more often than its language (`term`, TOP_TERMS)."""
    shards = shard_count(docs)
    freq = stored(frequencies(docs, lang, source, text, postings))
    # every group counts, also without terms
    known = _plain(docs, lang, source).distinct()
    own = freq.select("lang", F.explode(F.arrays_zip("sources", "counts")).alias("c")).groupBy("lang", F.col("c.sources").alias("source")).agg(F.sum("c.counts").alias("n"))
    kept = freq.groupBy("lang").agg(F.count("*").alias("v"), F.sum(F.aggregate("counts", F.lit(0).cast("bigint"), lambda s, c: s + c)).alias("n_lang"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    groups = stored(known.join(own, ["lang", "source"], "left").join(kept, "lang", "left").select("lang", "source", zero("n"), zero("v"), zero("n_lang")))
    dealt = groups.where("v > 0").withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)).cast("array<int>")))
    parts = freq.groupBy("lang", "shard").cogroup(dealt.groupBy("lang", "shard")).applyInArrow(_streamed, _PARTS)
    # a list of all pairs is asked for; sums of 0 have no part
    other = groups.select("lang", F.col("source").alias("item"))
    sums = stored(parts)
    empty = groups.select("lang", "source").join(other, "lang").where("source <> item").select("lang", "source", F.lit("pair").alias("part"), "item", F.lit(0).cast("bigint").alias("value"))
    pairs = sums.where("part = 'pair'").unionByName(empty).groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), F.col("item").asc())
    ranked = lambda df: df.withColumn("rank", F.row_number().over(order))
    # the first terms of a group are looked for in each task before the shuffle
    return ranked(pairs).unionByName(ranked(sums.where("part = 'term'")).where(F.col("rank") <= TOP_TERMS))


_SQL = """WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
t AS (SELECT id, lang, source, translate(unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM d),
k AS (SELECT lang, term, count(*) AS n FROM t GROUP BY lang, term HAVING count(DISTINCT id) >= 3),
l AS (SELECT lang, count(*) AS v, sum(n) AS n FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT t.lang, t.source, t.term, count(*) AS n FROM t JOIN k USING (lang, term) GROUP BY ALL),
s AS (SELECT lang, source, sum(n) AS n FROM c GROUP BY ALL),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, CAST(1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 1) // (coalesce(s.n, 0) + l.v) AS HUGEINT) AS p,
    CAST(1 + 1000000000::HUGEINT * (k.n + 1) // (l.n + l.v) AS HUGEINT) AS q
  FROM g JOIN k USING (lang) JOIN l USING (lang) LEFT JOIN c USING (lang, source, term) LEFT JOIN s USING (lang, source)),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(sum((x.p - y.p) * (x.p - y.p) // y.p), 0) AS value
  FROM g AS a JOIN g AS b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN p AS x ON x.lang = a.lang AND x.source = a.source
    LEFT JOIN p AS y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term GROUP BY ALL
  UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM r QUALIFY part = 'pair' OR rank <= 200"""


@query("op13_source_divergence", _SQL)
def op13_source_divergence(spark, sf_dir):
    return audit(table(spark, sf_dir, "documents"))
