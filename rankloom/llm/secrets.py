"""Secret scan: fixed patterns, and a battery of randomness tests on other tokens.

A token (a run of A-Z a-z 0-9 + / _ = -, TOKEN characters or more) is given the smallest encoding
that holds it: decimal, hex, base 32, letters and digits, or base 64.  Three tests ask whether it
could be drawn at random from that alphabet: chi-squared uniformity of the characters, the number of
runs above and below the middle of the alphabet, and the serial correlation of neighbours.  The
smallest of their p-values, times three, is the token's randomness.

How random ordinary writing looks is measured per length class and encoding on tokens made of all
words and numbers of less than TOKEN characters in the texts, shuffled, joined and cut at the least length of
the class; so the null does not depend on how many long words there are.  Each piece is there as often
as the root of its number, so that neither rare junk nor one common line rules; a few fixed pieces come
with them, and all are shuffled anew until there are NULLS tokens at least.  The pieces are dealt by hash
into decks, one per task, whose counts are added.  The share of null tokens that is as random is a
candidate's p-value; where few are, it is the extrapolation of the share's own decay, an upper bound
as the decay gets steeper.
Candidates are all tokens with a letter or digit, also those of letters or digits alone; ordinary long
words and numbers are left out by the false-discovery rule only.  Within each length class and encoding the
Benjamini-Hochberg rule keeps the expected share of false findings at Q, as far as ordinary tokens
look no more random than the null; short classes, where words look random, demand more.

A null text is the empty text.  Every row gives one row; equal texts give equal spans.  Texts are
read whole.  Spans are (kind, start, end) in code points, end exclusive; an added span (`random`)
never overlaps a base span.  Existing columns of the output names are replaced."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from rankloom.llm.common import slices, stored, strings
from rankloom.llm.registry import query, table

KINDS = ["assign", "access", "hex", "random"]
_ASSIGN = re.compile(r"(?ai:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_HINTS = ("passw", "secret", "token", "api")

# Least length of a tested token, lengths of the classes' lower ends, and bins of -log10 randomness.
TOKEN = 16
CLASSES = [16, 20, 24, 32, 40, 48, 64, 96]
BINS = 256
Q = 0.01
# Least null tokens per class and encoding, and pieces (with repeats) of a deck.
NULLS = 20_000
DECK = 1 << 16
# Share of numbers among the pieces of encodings with letters and digits, and of words with a capital
# where both cases occur; least null tokens of a share that is taken as it is.
NUMBERS, CAPITALS = 0.2, 0.5
COUNTED = 50
_PIECE = re.compile(r"[A-Za-z0-9+/_=-]+")
# Pieces for texts with few words or numbers of their own.
WORDS = ("the of and to in is that for with as was on are by this from have not which their other about would people system "
         "service number example between general company different important information development").split()
DIGITS = [*map(str, range(1, 32)), *map(str, range(1990, 2030)), "100", "1000", "443", "8080"]
_TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % TOKEN)
# The encodings, smallest alphabet first.
ALPHABETS = [
    ("decimal", "0123456789"),
    ("hex", "0123456789abcdef"),
    ("HEX", "0123456789ABCDEF"),
    ("base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("lower", "abcdefghijklmnopqrstuvwxyz"),
    ("upper", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("lower36", "0123456789abcdefghijklmnopqrstuvwxyz"),
    ("upper36", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("base62", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
    ("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"),
]
# Encodings whose places are the same but for case have one null.
SAME = {"HEX": "hex", "upper": "lower", "upper36": "lower36"}
_SETS = [(name, frozenset(a), {c: i for i, c in enumerate(a)}) for name, a in ALPHABETS]


def encoding(token: str) -> tuple[str, dict[str, int]]:
    used = set(token.rstrip("="))
    for name, letters, places in _SETS:
        if used <= letters:
            return name, places
    return "base64", _SETS[-1][2]


def _upper_tail(z: np.ndarray) -> np.ndarray:
    return 0.5 * np.frompyfunc(math.erfc, 1, 1)(z / math.sqrt(2)).astype(np.float64)


def randomness(token: str) -> float:
    """Three times the smallest p-value of the battery, at most 1; small for text-like tokens."""
    _, places = encoding(token)
    v = np.array([[places[c] for c in token.rstrip("=") if c in places]], dtype=np.int64)
    return float(battery(v, len(places))[0]) if v.shape[1] > 1 else 0.0


def battery(v: np.ndarray, size: int) -> np.ndarray:
    """The randomness of tokens of one length, given as rows of places in an alphabet of `size`."""
    rows, n = v.shape
    counts = np.bincount((v + size * np.arange(rows)[:, None]).ravel(), minlength=rows * size).reshape(rows, size)
    chi = ((counts - n / size) ** 2).sum(axis=1) * size / n
    # Wilson-Hilferty: the cube root of chi-squared over its degrees of freedom is nearly normal
    df = size - 1
    uniform = _upper_tail(((chi / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df)))
    high = v >= size / 2
    above = high.sum(axis=1)
    below = n - above
    runs = 1 + (high[:, 1:] != high[:, :-1]).sum(axis=1)
    mean = 1 + 2 * above * below / n
    var = np.maximum(1e-9, (mean - 1) * (mean - 2) / (n - 1))
    runs_p = 2 * _upper_tail(np.maximum(0.0, np.abs(runs - mean) - 0.5) / np.sqrt(var))
    balance = 2 * _upper_tail(np.abs(above - n * (size - math.ceil(size / 2)) / size) / math.sqrt(n / 4))
    runs_p = np.where((above > 0) & (below > 0), np.minimum(runs_p, balance), 2.0 ** (1 - n))
    centred = v - (size - 1) / 2
    spread = (size * size - 1) / 12
    serial = (centred[:, 1:] * centred[:, :-1]).sum(axis=1) / (spread * math.sqrt(n - 1))
    serial_p = 2 * _upper_tail(np.abs(serial))
    return np.minimum(1.0, 3 * np.minimum(uniform, np.minimum(runs_p, serial_p)))


def length_class(n: int) -> int:
    return int(np.searchsorted(CLASSES, n, side="right")) - 1


def bin_of(p: float) -> int:
    """0 for tokens that look random, up to BINS - 1 for those that don't."""
    return min(BINS - 1, int(-8 * math.log10(max(p, 1e-40))))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Matches of the fixed patterns as (start, kind number, end), in order."""
    found = []
    lower = text.lower()
    if any(h in lower for h in _HINTS):
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m.group(2)) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if len(m.group()) >= 20]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(found)


def _is_word(token: str) -> bool:
    return token.isalpha() and (token.islower() or token.isupper() or token.istitle())


def ordinary(texts: list[str]) -> Counter:
    """Words and numbers of less than TOKEN characters with their counts."""
    counts: Counter = Counter()
    for t in texts:
        counts.update(_PIECE.findall(t))
    return Counter({w: n for w, n in counts.items() if len(w) < TOKEN and (_is_word(w) or w.isdigit())})


def _stream(name: str, pieces: tuple[list[str], list[str]], copies: tuple[np.ndarray, np.ndarray], rng: np.random.Generator) -> np.ndarray:
    """Places in an encoding of words and numbers, shuffled and joined; each piece has its copies at least."""
    letters = dict(ALPHABETS)[name]
    places = {c: i for i, c in enumerate(letters)}
    numbers = NUMBERS if any(c.isalpha() for c in letters) and any(c.isdigit() for c in letters) else float(letters.isdigit())
    lower, upper = any(c.islower() for c in letters), any(c.isupper() for c in letters)
    shares = (1 - numbers, numbers)
    slots = max(c.sum() / p for c, p in zip(copies, shares) if p)
    listed, picked = [], []
    for some, c, share in zip(pieces, copies, shares):
        if share:
            picked.append(np.resize(rng.permutation(np.repeat(np.arange(len(some)) + len(listed), c)), math.ceil(slots * share)))
            listed += some
    order = rng.permutation(np.concatenate(picked))
    if lower and upper:
        order = order + len(listed) * (rng.random(len(order)) < CAPITALS)
        listed = listed + [w.title() for w in listed]
    else:
        listed = [w.lower() if lower else w.upper() for w in listed]
    if name == "base64":  # a mark, or nothing, after each piece
        marks = len(listed) + np.minimum(rng.integers(0, 8, len(order)), 4)
        listed = [*listed, *"+/_-", ""]
        order = np.stack([order, marks], axis=1).ravel()
    coded = [[places[c] for c in w if c in places] for w in listed]
    sizes = np.array([len(c) for c in coded])
    flat = np.array([x for c in coded for x in c], dtype=np.int64)
    taken = sizes[order]
    ends = np.cumsum(taken)
    return flat[np.repeat((np.cumsum(sizes) - sizes)[order] - (ends - taken), taken) + np.arange(ends[-1])]


def null_counts(name: str, classes: list[int], counted: dict[str, int], least: int = NULLS, deck: int = 0) -> dict[int, np.ndarray]:
    """Null tokens of an encoding by bin, for each length class: all pieces by the root of their counts, `least` tokens or more."""
    rng = np.random.default_rng([zlib.crc32(name.encode()), deck])
    own = [sorted(w for w in counted if w.isdigit() == digits) for digits in (False, True)]
    pieces = tuple(o or fixed for o, fixed in zip(own, (WORDS, DIGITS)))
    copies = tuple(np.array([math.isqrt(counted.get(w, 1)) for w in some]) for some in pieces)
    size = len(dict(ALPHABETS)[name])
    stream = _stream(name, pieces, copies, rng)
    whole = len(stream)
    if not whole:  # no piece has a character of the alphabet
        return {}
    streams, have = [stream], whole
    while have < least * max(CLASSES[c] for c in classes):
        streams.append(_stream(name, pieces, copies, rng))
        have += len(streams[-1])
    stream = np.concatenate(streams)
    out = {}
    for cls in classes:
        n = CLASSES[cls]
        tokens = max(-(-whole // n), least)
        rows = np.resize(stream[:tokens * n], tokens * n).reshape(tokens, n)
        found = np.zeros(BINS, dtype=np.int64)
        for start in range(0, tokens, 1 << 14):
            p = battery(rows[start:start + (1 << 14)], size)
            found += np.bincount(np.minimum(BINS - 1, (-8 * np.log10(np.maximum(p, 1e-40))).astype(np.int64)), minlength=BINS)
        out[cls] = found
    return out


def null_shares(counts: np.ndarray) -> np.ndarray:
    """The share of null tokens that is in each bin or a more random one."""
    found = np.cumsum(counts)
    if not found[-1]:
        return np.ones(BINS)
    shares = (found + 1) / (found[-1] + 1)
    # two well-counted places on the left give the line (of logarithms) that the rare bins stay below
    at, to = (int(np.searchsorted(found, x)) for x in (COUNTED, 20 * COUNTED))
    if 0 < at < to < BINS:
        slope = (math.log(shares[to]) - math.log(shares[at])) / (to - at)
        shares[:at] = shares[at] * np.exp(slope * (np.arange(at) - at))
    return shares


def scan(df: DataFrame, text: str = "text") -> DataFrame:
    """Add `base` (spans), `tested` (candidates with length class, encoding and bin) and, in the first
    row of each batch, `pieces` (its ordinary words and numbers, with counts)."""
    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("kind", T.IntegerType()), T.StructField("end", T.LongType())])
    token = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("size", T.IntegerType()),
                          T.StructField("encoding", T.IntegerType()), T.StructField("bin", T.IntegerType())])
    count = T.StructType([T.StructField("piece", T.StringType()), T.StructField("n", T.LongType())])
    added = [T.StructField("base", T.ArrayType(span)), T.StructField("tested", T.ArrayType(token)), T.StructField("pieces", T.ArrayType(count))]
    names = [f.name for f in added]
    schema = T.StructType([f for f in df.schema.fields if f.name not in [*names, text]] + added)
    from pyspark.sql.pandas.types import to_arrow_schema
    kinds = to_arrow_schema(T.StructType(added))
    numbers = {name: i for i, (name, _) in enumerate(ALPHABETS)}

    def run(batches):
        for part in slices(batches, text):
            bases, tests = [], []
            texts = strings(part.column(text))
            for t in texts:
                base = base_spans(t)
                tested = []
                for m in _TOKEN.finditer(t):
                    tok = m.group()
                    if any(c.isalnum() for c in tok):
                        tested.append({"start": m.start(), "end": m.end(), "size": length_class(len(tok)), "encoding": numbers[encoding(tok)[0]], "bin": bin_of(randomness(tok))})
                bases.append([{"start": a, "kind": k, "end": b} for a, k, b in base])
                tests.append(tested)
            counts = ordinary(texts)
            pieces = pa.ListArray.from_arrays(pa.array([0] + [len(counts)] * len(texts), pa.int32()), pa.StructArray.from_arrays(
                [pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], names=["piece", "n"]))
            kept = [n for n in part.schema.names if n not in [*names, text]]
            yield pa.RecordBatch.from_arrays([part.column(n) for n in kept] + [
                pa.array(v, kinds.field(n).type) for v, n in zip((bases, tests), names)] + [pieces.cast(kinds.field("pieces").type)], names=kept + names)

    return df.mapInArrow(run, schema)


def nulls(scanned: DataFrame, wanted: dict[str, list[int]]) -> DataFrame:
    """(encoding, size, bin, n): null tokens of all the ordinary words and numbers, for the classes wanted of each encoding."""
    fixed = scanned.sparkSession.createDataFrame([(w, 1) for w in [*WORDS, *DIGITS]], "piece string, n long")
    counted = stored(scanned.select(F.inline("pieces")).unionByName(fixed).groupBy("piece").agg(F.sum("n").alias("n")))
    decks = -(-counted.agg(F.sum(F.floor(F.sqrt("n")))).first()[0] // DECK)
    numbers = {name: i for i, (name, _) in enumerate(ALPHABETS)}

    def deck(part: pa.Table) -> pa.Table:
        pieces = dict(zip(part.column("piece").to_pylist(), part.column("n").to_pylist()))
        out = []
        for name, classes in wanted.items():
            for cls, found in null_counts(name, classes, pieces, -(-NULLS // decks), part.column("deck")[0].as_py()).items():
                out += [(numbers[name], cls, at, int(found[at])) for at in np.flatnonzero(found).tolist()]
        columns = zip(*out) if out else [()] * 4
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int32(), pa.int32(), pa.int32(), pa.int64()))],
                                    names=["encoding", "size", "bin", "n"])

    # decks are small in bytes but take seconds each: by their number, or few tasks would get them all
    dealt = counted.withColumn("deck", F.pmod(F.xxhash64("piece"), F.lit(decks))).repartition(decks, "deck")
    return dealt.groupBy("deck").applyInArrow(deck, "encoding int, size int, bin int, n long").groupBy("encoding", "size", "bin").agg(F.sum("n").alias("n"))


def _by_class(rows) -> dict[tuple[int, int], np.ndarray]:
    out: dict[tuple[int, int], np.ndarray] = {}
    for r in rows:
        out.setdefault((r["size"], r["encoding"]), np.zeros(BINS, dtype=np.int64))[r["bin"]] += r["n"]
    return out


def thresholds(scanned: DataFrame, q: float = Q) -> dict[tuple[int, int], int]:
    """The largest bin of each length class and encoding at which findings stay under the false share `q`.

    Counts come as one row per class, encoding and bin: a number that does not depend on the data."""
    numbers = {name: i for i, (name, _) in enumerate(ALPHABETS)}
    seen = _by_class(scanned.select(F.inline("tested")).groupBy("size", "encoding", "bin").agg(F.count("*").alias("n")).collect())
    if not seen:
        return {}
    like = {(cls, number): SAME.get(ALPHABETS[number][0], ALPHABETS[number][0]) for cls, number in seen}
    wanted = {name: sorted({cls for (cls, _), of in like.items() if of == name}) for name in sorted(set(like.values()))}
    null = _by_class(nulls(scanned, wanted).collect())
    out = {}
    for (cls, number), counts in sorted(seen.items()):
        found = np.cumsum(counts)
        p = null_shares(null.get((cls, numbers[like[cls, number]]), np.zeros(BINS)))
        good = np.flatnonzero((found > 0) & (p * found[-1] <= q * np.maximum(found, 1)))
        if len(good):
            out[cls, number] = int(good[-1])
    return out


def find(df: DataFrame, text: str = "text", q: float = Q) -> DataFrame:
    """Replace the text by `spans`: all findings as (start, kind number, end), in order."""
    scanned = stored(scan(df, text))
    limits = thresholds(scanned, q)
    limit_of = lambda t: F.coalesce(*[F.when((t["size"] == c) & (t["encoding"] == e), F.lit(b)) for (c, e), b in limits.items()], F.lit(-1))
    added = F.filter("tested", lambda t: (t["bin"] <= limit_of(t)) & ~F.exists("base", lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"])))
    spans = F.array_sort(F.concat("base", F.transform(added, lambda t: F.struct(
        t["start"].alias("start"), F.lit(KINDS.index("random")).alias("kind"), t["end"].alias("end")))))
    return scanned.withColumn("spans", spans).drop("tested", "pieces")


def listed(spans):
    """Spans as kind:start:end, comma-joined."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", kinds[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")


@query("op7_random_secrets")
def op7_random_secrets(spark, sf_dir):
    found = find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == KINDS.index(kind))).cast("bigint")
    return found.select("doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
                        F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
