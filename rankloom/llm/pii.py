"""Personal data: fixed patterns, and identifiers that their contexts give away.

Seeds are the matches of four patterns (email, ip, card, phone).  A match of the right form that fails
the check of its kind (as a number of a card's length does by its check digit) is disproved: its belief
stays 0.  Every other token with a digit or an @, of LEAST characters or more, is an instance of unknown
worth; instances after no plain word are left alone.  The words around an instance, in a window of WINDOW characters on each side, are its lexical
patterns: the word before with the word after, the two words before, and the word before with the
token's shape (runs of letters and digits as one sign each).  The first two say nothing of the token
itself, so they meet identifiers of forms that no seed has.

Spark scores the graph of patterns and instances in turns: a pattern is as good as the share of its
distinct instances that are believed, smoothed; an instance is believed as much as its best pattern,
seeds fully, disproved ones never.  Belief so passes from seeds to the unknown instances beside them, and from these to
contexts without any seed; a context in which unknown instances far outnumber believed ones stays
doubtful after ROUNDS.  Tokens in patterns that end with CONFIDENCE or more, of which SUPPORT instances
are believed that much, are found too (kind `context`).  They overlap no seed and nothing disproved.

All of it is built of DataFrame expressions.  Positions are running sums of the lengths of matches and
of the pieces between them, taken in blocks, so a text's cost grows with its length, not its square.
The expressions are rewritten without backtracking (possessive, starting only where a run starts), so
very long runs cost linear time; the matches are the same.

A null text is the empty text and has no findings.  Equal texts have equal findings, so these are
joined by the text's digest; null or repeated ids and extra columns are no trouble.  Spans are code
points, end exclusive."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rankloom.llm.common import stored
from rankloom.llm.registry import query, table

KINDS = ["email", "ip", "card", "phone", "context"]
# What each expression needs, tested first, and the expression.
PATTERNS = [
    ("@", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    (r"[0-9]\.[0-9]", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"),
    (r"[0-9](?:[ -]?[0-9]){13}", r"(?<![0-9])[0-9](?:[ -]?[0-9])++"),
    (r"\+[0-9]", r"\+[0-9][ ().0-9-]+[0-9]"),
]
# A token with a digit or an @, without opening punctuation before it.
TOKEN = r"(?<![^\s(\[\"'<])(?=[^\s(\[\"'<0-9@]*+[0-9@])[^\s(\[\"'<]++"
ROUNDS, CONFIDENCE, SUPPORT, SMOOTH = 5, 0.8, 5, 2.0
LEAST, WINDOW = 4, 64
MASKS = {"email": "<EMAIL>", "ip": "<IP>", "card": "<CARD>", "phone": "<PHONE>", "context": "<ID>"}

SPAN = "array<struct<start:bigint,kind:int,end:bigint>>"
TOKENS = "array<struct<start:bigint,end:bigint,patterns:array<string>,value:string,seed:boolean>>"
# Elements of a block of running values, and characters of a piece that masked texts are cut from.
BLOCK, PIECE = 128, 4096
FAR = 2**62


def _let(value: Column, body) -> Column:
    """body(value), with the value computed once; expressions in lambdas are computed at each call."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _running(values: Column, joined) -> Column:
    """Running values (sums, maxima) of an array of longs.  An array that grows in a fold is copied at
    every step, so folds are over blocks and over the totals of blocks."""
    def fold(block):
        return F.aggregate(block, F.array().cast("array<bigint>"), lambda a, x: F.concat(a, F.array(F.coalesce(joined(F.try_element_at(a, F.lit(-1)), x), x))))

    def carried(b):
        return _let(fold(F.transform(b, lambda x: F.try_element_at(x, F.lit(-1)))), lambda totals: F.flatten(F.transform(
            b, lambda x, n: F.transform(x, lambda y: F.coalesce(joined(F.get(totals, n - 1), y), y)))))

    def blocks(v):
        starts = F.sequence(F.lit(1), F.greatest(F.size(v), F.lit(1)), F.lit(BLOCK))
        return _let(F.transform(starts, lambda i: fold(F.slice(v, i, BLOCK))), carried)

    return _let(values, blocks)


def _placed(text: Column, pattern: str) -> Column:
    """All matches, in order, as (start, end, before, value, after): what lies between it and the
    matches, or ends of the text, on both sides."""
    hits, rest = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)

    def with_ends(m):
        lengths = F.zip_with(m["hits"], F.slice(m["rest"], 1, F.size(m["hits"])), lambda v, b: (F.length(v) + F.length(b)).cast("bigint"))
        return _let(_running(lengths, lambda a, b: a + b), lambda ends: F.transform(m["hits"], lambda v, n: F.struct(
            (F.get(ends, n) - F.length(v)).alias("start"), F.get(ends, n).alias("end"), F.get(m["rest"], n).alias("before"),
            v.alias("value"), F.get(m["rest"], n + 1).alias("after"))))

    return _let(F.struct(hits.alias("hits"), rest.alias("rest")), with_ends)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def add(total, i):
        d = F.substring(digits, F.length(digits) - i + 1, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _passes(kind: str, value: Column) -> Column:
    """Whether a match is one of its kind; null where it does not even have the form."""
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: p.rlike("^0*([0-9]|[1-9][0-9]|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        digits = _digits(value)
        return F.when(F.length(digits).between(14, 19), _luhn(digits))
    if kind == "phone":
        return F.length(_digits(value)).between(10, 15)
    return F.lit(True)


def _base(text: Column, kind: str, made) -> Column:
    """made(match, number of its kind) of the matches of the fixed patterns, without those that it
    makes null, in order."""
    none = F.array().cast(kind)

    def found(number: int, hint: str, pattern: str) -> Column:
        there = F.contains(text, F.lit(hint)) if hint == "@" else text.rlike(hint)
        return F.when(there, F.filter(F.transform(_placed(text, pattern), lambda m: made(m, number)), lambda m: m.isNotNull()).cast(kind)).otherwise(none)

    return F.sort_array(F.concat(*[found(i, hint, pattern) for i, (hint, pattern) in enumerate(PATTERNS)]))


def base_spans(text: Column) -> Column:
    """Matches of the fixed patterns that pass their checks, as (start, kind, end), in order."""
    return _base(text, SPAN, lambda m, number: F.when(_passes(KINDS[number], m["value"]), F.struct(
        m["start"].alias("start"), F.lit(number).alias("kind"), m["end"].alias("end"))))


def _shape(value: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(value, r"\p{L}+", "a"), "[0-9]+", "9")


def _contexts(before: Column, value: Column, after: Column) -> Column:
    """The lexical patterns of a value between two pieces of text; none after no plain word."""
    left = F.lower(F.regexp_replace(F.substring(before, -WINDOW, WINDOW), r"[\s(\[\"'<]+$", ""))
    right = F.regexp_extract(F.lower(F.substring(after, 1, WINDOW)), r"^\s*([)\]\"'>,.;:!?]|[^\s)\]\"'>,.;:!?]+)", 1)
    plain = F.when(right.rlike("[0-9@]"), F.lit("#")).otherwise(right)
    one, two = F.regexp_extract(left, r"(\S+)$", 1), F.regexp_extract(left, r"(\S+)\s+\S+$", 1)
    named = F.filter(F.array(F.concat(one, F.lit(" * "), plain), F.when(two != "", F.concat(two, F.lit(" "), one, F.lit(" *"))),
                             F.concat(one, F.lit(" "), _shape(value))), lambda p: p.isNotNull())
    return F.when((one != "") & ~one.rlike("[0-9@]"), named).otherwise(F.array().cast("array<string>"))


def _judged(text: Column) -> Column:
    """Matches that have the form of a kind: seeds, and those that fail its check."""
    def made(m, number):
        return _let(_passes(KINDS[number], m["value"]), lambda good: F.when(good.isNotNull(), F.struct(
            m["start"].alias("start"), F.lit(number).alias("kind"), m["end"].alias("end"),
            _contexts(m["before"], m["value"], m["after"]).alias("patterns"), m["value"].alias("value"), good.alias("seed"))))

    return _base(text, "array<struct<start:bigint,kind:int,end:bigint,patterns:array<string>,value:string,seed:boolean>>", made)


def _unknown(text: Column, base: Column) -> Column:
    """Tokens that overlap no span of `base`, as the instances of the graph."""
    def described(t):
        core = F.regexp_replace(t["value"], r"(?<![)\]\"'>,.;:!?])[)\]\"'>,.;:!?]++$", "")
        tail = F.substring(t["value"], F.length(core) + 1, F.lit(WINDOW))
        patterns = _contexts(t["before"], core, F.concat(tail, F.substring(t["after"], 1, WINDOW)))
        # the lengths decide first: tables of numbers have white space only between them
        return F.struct(t["start"].alias("start"), (t["start"] + F.length(core)).alias("end"),
                        F.when((F.length(core) >= LEAST) & core.rlike("[0-9@]") & t["before"].rlike(r"[^\s(\[\"'<]"), patterns)
                        .otherwise(F.array().cast("array<string>")).alias("patterns"), core.alias("value"), F.lit(None).cast("boolean").alias("seed"))

    def apart(own):
        # spans and tokens in one order: the furthest end of spans so far, and the start of the next one
        spans = F.transform(base, lambda b: F.struct(b["start"].alias("start"), F.lit(-1).alias("n"), b["end"].alias("end")))
        each = F.transform(own, lambda t, n: F.struct(t["start"].alias("start"), n.alias("n"), t["end"].alias("end")))

        def judged(order):
            ends = _running(F.transform(order, lambda o: F.when(o["n"] < 0, o["end"]).otherwise(F.lit(0).cast("bigint"))), F.greatest)
            nexts = _running(F.transform(F.reverse(order), lambda o: F.when(o["n"] < 0, o["start"]).otherwise(F.lit(FAR).cast("bigint"))), F.least)
            return _let(F.struct(ends.alias("ends"), F.reverse(nexts).alias("nexts")), lambda r: F.transform(
                F.filter(order, lambda o, i: (o["n"] >= 0) & (F.get(r["ends"], i) <= o["start"]) & (F.get(r["nexts"], i) >= o["end"])),
                lambda o: F.get(own, o["n"])))

        return F.when((F.size(own) == 0) | (F.size(base) == 0), own).otherwise(_let(F.sort_array(F.concat(spans, each)), judged))

    tokens = F.filter(F.transform(_placed(text, TOKEN), described), lambda t: F.size(t["patterns"]) > 0)
    return F.when(text.rlike("[0-9@]"), _let(tokens.cast(TOKENS), apart)).otherwise(F.array().cast(TOKENS))


def scan(df: DataFrame, text: str = "text") -> DataFrame:
    """(digest, base, tokens) of every row, with the row's other columns but the text.  Tokens are the
    instances of the graph: (start, end, patterns, value, seed), seed null for unknown ones."""
    names = ["digest", "base", "tokens"]
    value = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    own = [F.col(f"`{c}`") for c in df.columns if c not in [*names, text]]
    rows = df.select(*own, value.alias("__text"), _judged(value).alias("__judged"))
    known = F.transform(F.filter("__judged", lambda b: F.size(b["patterns"]) > 0), lambda b: F.struct(
        *[b[c].alias(c) for c in ("start", "end", "patterns", "value", "seed")])).cast(TOKENS)
    plain = F.transform(F.filter("__judged", lambda b: b["seed"]), lambda b: F.struct(*[b[c].alias(c) for c in ("start", "kind", "end")]))
    return rows.select(*own, plain.cast(SPAN).alias("base"), F.concat(known, _unknown(F.col("__text"), F.col("__judged"))).alias("tokens"),
                       F.md5("__text").alias("digest"))


def patterns(scanned: DataFrame, rounds: int = ROUNDS, confidence: float = CONFIDENCE, support: int = SUPPORT) -> DataFrame:
    """The lexical patterns that may be trusted, with confidence and number of believed instances.

    The graph has an edge for each pattern and value; counts are summed in tasks first, so a value
    or pattern of any frequency is one edge.  Copies of a text count once."""
    texts = scanned.where(F.size("tokens") > 0).groupBy("digest").agg(F.first("tokens").alias("tokens"))
    each = texts.select(F.explode("tokens").alias("t")).select("t.value", "t.seed", F.explode("t.patterns").alias("pattern"))
    edges = stored(each.groupBy("pattern", "value").agg(F.max(F.col("seed").cast("double")).alias("seed")))
    belief = edges.groupBy("value").agg(F.coalesce(F.max("seed"), F.lit(0.0)).alias("belief"))
    scored = lambda known: edges.join(known, "value").groupBy("pattern").agg(
        (F.sum("belief") / (F.count("*") + SMOOTH)).alias("confidence"), F.count_if(F.col("belief") >= confidence).alias("support"))
    for _ in range(rounds):
        seen = edges.join(scored(belief), "pattern").groupBy("value").agg(F.max("seed").alias("seed"), F.max("confidence").alias("best"))
        belief = stored(seen.select("value", F.coalesce("seed", "best").alias("belief")))
    return scored(belief).where((F.col("confidence") >= confidence) & (F.col("support") >= support))


def discovered(scanned: DataFrame) -> DataFrame:
    """(digest, context): the spans that trusted patterns add to each text that has any."""
    found = patterns(scanned).select("pattern")
    own = F.filter("tokens", lambda t: t["seed"].isNull())
    one = scanned.where(F.size(own) > 0).groupBy("digest").agg(F.first("tokens").alias("tokens"))
    rows = one.select("digest", F.explode(own).alias("t")).select("digest", "t.start", "t.end", F.explode("t.patterns").alias("pattern"))
    return rows.join(found, "pattern").groupBy("digest").agg(F.sort_array(F.collect_set(
        F.struct("start", F.lit(KINDS.index("context")).alias("kind"), "end"))).cast(SPAN).alias("context"))


def find(df: DataFrame, text: str = "text") -> DataFrame:
    """Replace the text by base (spans of the fixed patterns) and spans (all), in order."""
    scanned = stored(scan(df, text))
    added = discovered(scanned)
    rows = scanned.drop("tokens").join(added, "digest", "left")
    return rows.withColumn("spans", F.sort_array(F.concat("base", F.coalesce("context", F.array().cast(SPAN))))).drop("digest", "context")


def masked(text: Column, spans: Column) -> Column:
    """The text with every span (overlapping ones joined) replaced by the mask of its kind.

    What lies between spans is cut from the text's pieces of PIECE characters, as the cut of a whole
    text takes time in proportion to where it starts."""
    masks = F.array(*[F.lit(MASKS[k]) for k in KINDS])

    def cut(pieces, start, end):
        first, last = F.floor(start / PIECE), F.floor((end - 1) / PIECE)
        near = F.array_join(F.slice(pieces, (first + 1).cast("int"), (last - first + 1).cast("int")), "")
        return F.when(start >= end, F.lit("")).otherwise(F.substring(near, (start - first * PIECE + 1).cast("int"), (end - start).cast("int")))

    def replaced(v):
        def part(s, n):
            reached = F.when(n == 0, F.lit(0).cast("bigint")).otherwise(F.get(v["ends"], n - 1))
            return F.when(s["start"] < reached, F.lit("")).otherwise(F.concat(cut(v["pieces"], reached, s["start"]), F.get(masks, s["kind"])))

        return F.concat(F.array_join(F.transform(v["spans"], part), ""), cut(v["pieces"], F.element_at(v["ends"], -1), F.length(text).cast("bigint")))

    def with_ends(s):
        ends = _running(F.transform(s, lambda x: x["end"]), F.greatest)
        pieces = F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % PIECE), F.lit(0))
        return _let(F.struct(s.alias("spans"), ends.alias("ends"), pieces.alias("pieces")), replaced)

    return _let(spans, lambda s: F.when(F.size(s) > 0, with_ends(s)).otherwise(text))


def redact(df: DataFrame, text: str = "text") -> DataFrame:
    """The rows with all findings masked in the text.  Null texts stay null.

    The found contexts (few texts have any) are joined to the rows by the text's digest."""
    # the text's own column goes through the join once; digests of copies may be a hot key, which adaptive joins split
    only = F.col(f"`{text}`")
    scanned = stored(scan(df.select(only.alias(text)).where(only.rlike("[0-9@]")), text))
    added = stored(discovered(scanned).select(F.col("digest").alias("__digest"), "context"))  # of known size
    rows = df.withColumn("__key", F.md5(F.coalesce(only, F.lit("")))).join(added, F.col("__key") == F.col("__digest"), "left")
    spans = F.sort_array(F.concat(base_spans(only), F.coalesce("context", F.array().cast(SPAN))))
    return rows.select(*[(F.when(only.isNotNull(), masked(only, spans)).alias(text) if c == text else F.col(f"`{c}`")) for c in df.columns])


def listed(spans) -> Column:
    """Spans as kind:start:end, comma-joined."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", kinds[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")


@query("op5_context_bootstrap")
def op5_context_bootstrap(spark, sf_dir):
    found = find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda i: F.size(F.filter("base", lambda s: s["kind"] == i)).cast("bigint")
    return found.select("doc_id", *[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS[:4])],
                        F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
