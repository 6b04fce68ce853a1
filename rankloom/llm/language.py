"""Language identification as a mixture of languages.

Training counts character n-grams (one to four letters of words with their borders) per language
over a bounded sample of labelled documents.  A document is then a mixture: each word is drawn
from language l with proportion pi_l, and expectation-maximisation estimates the proportions from
the words' n-gram likelihoods.  The set of languages is chosen by penalised likelihood: starting
from all, languages are dropped while that lowers -2 log L + k log n.

A null text, or one without a letter, is `und` with score 0 and no proportions.  Equal texts get
equal results; ties go to the language first in alphabetical order.  An empty training set gives
`und` for everything.  Texts are read whole, however long.  Only the text is used to predict."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from rankloom.llm.common import slices, strings
from rankloom.llm.registry import query, table

# Longest n-gram, in characters.
GRAM = 4
# Cells of the hashed n-gram table of each language.
CELLS = 1 << 18
# Training documents per language, at most; those of smallest hash are taken.
TRAIN_DOCS = 1500
# Words remembered per Python worker; the store is emptied when full.
MEMORY_WORDS = 250_000
# Steps of expectation-maximisation, and the change of log-likelihood per word that ends it.
STEPS, SETTLED = 30, 1e-5
UNKNOWN = "und"

_WORD = re.compile(r"[^\W\d_]+")


def _grams(word: str) -> list[int]:
    """Hashed n-grams of a word with its borders."""
    w = f" {word} "
    out = []
    for n in range(1, GRAM + 1):
        out.extend(zlib.crc32(w[i:i + n].encode("utf-8")) % CELLS for i in range(len(w) - n + 1))
    return out


def train(df: DataFrame, text: str = "text", lang: str = "lang", docs: int = TRAIN_DOCS) -> dict:
    """Log-likelihood tables of every language that `lang` names.

    At most `docs` different texts of each language are read, those with the smallest hash; copies
    count once.  Their n-gram counts, hashed into CELLS cells, are summed by Spark; what comes to the driver is
    at most languages x CELLS numbers.  Rows with a null language or text are left out."""
    labelled = (df.select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
                .where("lang IS NOT NULL AND text IS NOT NULL").withColumn("h", F.xxhash64("text")))
    # the cut-off hash of each language comes from partial aggregates of hashes, without texts
    rank = F.array_sort(F.collect_set("h"))
    total = labelled.select("lang", "h").distinct().groupBy("lang").agg(F.count("*").alias("n")).collect()
    if not total:
        return {"langs": [], "table": np.zeros((0, CELLS), dtype=np.float32)}
    # a window of the hashes with a margin over its chance variation, so that it holds `docs` if there are so many
    share = {r["lang"]: min(1.0, (docs + 8 * docs ** 0.5 + 32) / r["n"]) for r in total}
    low = F.lit(-(1 << 63)).cast("long")
    limit = F.create_map(*chain.from_iterable((F.lit(k), F.lit(min((1 << 63) - 1, int(-(1 << 63) + v * ((1 << 64) - 1))))) for k, v in share.items()))
    near = labelled.where((F.col("h") >= low) & (F.col("h") <= limit[F.col("lang")]))
    cut = near.groupBy("lang").agg(F.slice(rank, 1, docs).alias("kept")).select(
        F.col("lang").alias("cut_lang"), F.element_at("kept", -1).alias("cut"))
    cuts = {r["cut_lang"]: r["cut"] for r in cut.collect()}
    bound = F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in cuts.items()))
    sample = near.where(F.col("h") <= bound[F.col("lang")])
    # copies go in the tasks first, so that few texts move
    sample = sample.mapInArrow(_different, sample.schema).dropDuplicates(["lang", "h"])
    sums = sample.select("lang", "text").mapInArrow(_count, "lang string, cell int, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n"))
    rows = sums.toArrow()
    langs = sorted(cuts)
    counts = np.zeros((len(langs), CELLS), dtype=np.float64)
    at = np.array([langs.index(x) for x in rows.column("lang").to_pylist()], dtype=np.int64)
    counts[at, rows.column("cell").to_numpy()] = rows.column("n").to_numpy()
    seen = max(1, int((counts.sum(axis=0) > 0).sum()))
    table_ = np.log((counts + 0.5) / (counts.sum(axis=1, keepdims=True) + 0.5 * seen))
    return {"langs": langs, "table": table_.astype(np.float32)}


def _different(batches):
    """The first row of each language and hash."""
    seen = set()
    for batch in batches:
        keys = list(zip(batch.column("lang").to_pylist(), batch.column("h").to_pylist()))
        keep = []
        for key in keys:
            keep.append(key not in seen)
            seen.add(key)
        yield batch.filter(pa.array(keep, pa.bool_()))


def _count(batches):
    for batch in batches:
        by_lang: dict[str, Counter] = {}
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
            by_lang.setdefault(lang, Counter()).update(_WORD.findall(text.lower()))
        langs, cells, numbers = [], [], []
        for lang, words in by_lang.items():
            grams: Counter = Counter()
            for word, n in words.items():
                for g in _grams(word):
                    grams[g] += n
            langs += [lang] * len(grams)
            cells += grams.keys()
            numbers += grams.values()
        yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(cells, pa.int32()), pa.array(numbers, pa.int64())],
                                         names=["lang", "cell", "n"])


class Mixer:
    """Word likelihoods and the mixture of one text."""

    def __init__(self, model: dict):
        self.langs, self.table = model["langs"], model["table"]
        self.at: dict[str, int] = {}
        self.scores = np.empty((0, len(self.langs)))

    def _learn(self, words: list[str]) -> None:
        if len(self.at) > MEMORY_WORDS:
            self.at, self.scores = {}, self.scores[:0]
        new = [w for w in dict.fromkeys(words) if w not in self.at]
        if not new:
            return
        grams = [_grams(w) for w in new]
        sizes = np.array([len(g) for g in grams])
        flat = np.fromiter(chain.from_iterable(grams), dtype=np.int64, count=int(sizes.sum()))
        starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        # the geometric mean keeps long words from counting as several
        means = np.add.reduceat(self.table[:, flat], starts, axis=1).T / np.sqrt(sizes)[:, None]
        self.at.update(zip(new, range(len(self.scores), len(self.scores) + len(new))))
        self.scores = np.concatenate([self.scores, means.astype(np.float64)])

    def mixtures(self, texts: list[str]) -> list[dict[str, float]]:
        """Proportions of the chosen languages of each text; empty for texts without a letter."""
        cut = [_WORD.findall(t.lower()) for t in texts]
        out: list[dict[str, float]] = []
        start = 0
        while start < len(cut):
            # the store must hold all words of the texts at hand
            stop, words = start, []
            while stop < len(cut) and (stop == start or len(words) + len(cut[stop]) <= MEMORY_WORDS):
                words += cut[stop]
                stop += 1
            self._learn(words)
            out += [self.mixture(ws) for ws in cut[start:stop]]
            start = stop
        return out

    def mixture(self, words: list[str]) -> dict[str, float]:
        if not words or not self.langs:
            return {}
        ids, counts = np.unique(np.fromiter(map(self.at.__getitem__, words), dtype=np.int64, count=len(words)), return_counts=True)
        log_p = self.scores[ids]
        top = log_p.max(axis=1, keepdims=True)
        p = np.exp(log_p - top)
        chosen = list(range(len(self.langs)))
        pi, fit = self._fit(p, counts, chosen)
        penalty = np.log(max(2, len(words)))
        while len(chosen) > 1:
            weakest = chosen[int(np.argmin(pi))]
            rest = [c for c in chosen if c != weakest]
            pi_less, fit_less = self._fit(p, counts, rest)
            if 2 * (fit - fit_less) > penalty:
                break
            chosen, pi, fit = rest, pi_less, fit_less
        return {self.langs[c]: float(x) for c, x in zip(chosen, pi)}

    @staticmethod
    def _fit(p: np.ndarray, counts: np.ndarray, chosen: list[int]) -> tuple[np.ndarray, float]:
        q = p[:, chosen] + 1e-300
        if len(chosen) == 1:
            return np.ones(1), float(counts @ np.log(q[:, 0]))
        pi, before, total = np.full(len(chosen), 1 / len(chosen)), -np.inf, counts.sum()
        for _ in range(STEPS):
            mixed = q @ pi
            fit = float(counts @ np.log(mixed))
            pi = pi * (q.T @ (counts / mixed)) / total
            if fit - before < SETTLED * total:
                break
            before = fit
        return pi, fit


def identify(df: DataFrame, model: dict, text: str = "text", out: str = "languages", lang: str = "lang_pred",
             score: str = "score") -> DataFrame:
    """Add the mixture as a map, its largest language and that language's proportion.

    The model (languages x CELLS floats) is broadcast; its size does not depend on the data.
    Existing columns of the output names are replaced."""
    spark = df.sparkSession
    if model["table"].nbytes > 512 * 1024 * 1024:
        raise ValueError("too many languages for one broadcast table")
    shared = spark.sparkContext.broadcast(model)
    added = [(out, T.MapType(T.StringType(), T.DoubleType())), (lang, T.StringType()), (score, T.DoubleType())]
    names = [n for n, _ in added]
    schema = T.StructType([f for f in df.schema.fields if f.name not in names] + [T.StructField(n, k) for n, k in added])

    def run(batches):
        mixer = Mixer(shared.value)
        for part in slices(batches, text):
            found = mixer.mixtures(strings(part.column(text)))
            best = [max(m.items(), key=lambda kv: (kv[1], [-ord(c) for c in kv[0]])) if m else (UNKNOWN, 0.0) for m in found]
            kept = [n for n in part.schema.names if n not in names]
            columns = [part.column(n) for n in kept] + [
                pa.array([list(m.items()) for m in found], pa.map_(pa.string(), pa.float64())),
                pa.array([b[0] for b in best], pa.string()), pa.array([min(1.0, b[1]) for b in best], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=kept + names)

    return df.mapInArrow(run, schema)


def fold(doc_id: str = "doc_id"):
    """crc32 of the id as text, modulo 4."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4


@query("op9_language_mixture")
def op9_language_mixture(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = train(docs.where(fold() != 2).select("text", "lang"))
    held = docs.select("doc_id", "text", F.coalesce(fold() == 2, F.lit(False)).alias("held_out"))
    return identify(held, model).select("doc_id", "held_out", "lang_pred", "score", "languages")
