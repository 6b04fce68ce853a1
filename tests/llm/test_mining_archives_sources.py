"""Hard negatives, archives and the source audit against brute force and on awkward rows."""

import gzip
import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankloom.llm import divergence, negatives, warc


# --- hard negatives


def brute_negatives(rows, step=10):
    """The contract, row by row: (id, label, vector) with vectors of one length each."""
    sound = sorted({(i, l, tuple(int(np.floor(256 * np.float64(x))) for x in v)) for i, l, v in rows
                    if None not in (i, l, v) and all(x is not None and np.isfinite(x) for x in v)})
    out = []
    for a, la, va in sound:
        if a % step:
            continue
        score = [(-sum(x * y for x, y in zip(va, v)), i, l) for i, l, v in sound if len(v) == len(va)]
        own = sorted((s, i) for s, i, l in score if l == la and i != a)[:5]
        rest = sorted((s, i) for s, i, l in score if l != la)
        for p, i in own:
            fit = [(s, j) for s, j in rest if 80 * -p <= 100 * -s <= 100 * -p][:5]
            out += [(a, i, r, j, -p, -s) for r, (s, j) in enumerate(fit, 1)]
    return sorted(out)


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")


@pytest.mark.parametrize("spread, dim", [(0.3, 8), (3.0, 3), (2e4, 5), (5e5, 4)])
def test_negatives_are_brute_force(spark, monkeypatch, spread, dim):
    monkeypatch.setattr(negatives, "BLOCK_ROWS", 16)
    monkeypatch.setattr(negatives, "ANCHOR_ROWS", 2)
    rng = np.random.default_rng(dim)
    rows = [(i, int(rng.integers(3)), (rng.normal(size=dim) * spread + spread).tolist()) for i in range(120)]
    rows += [(200 + i, int(rng.integers(3)), rows[0][2]) for i in range(40)]  # ties
    got = negatives.mine(negatives.prepared(vectors(spark, rows)), F.col("id") % 10 == 0)
    assert sorted(map(tuple, got.collect())) == brute_negatives(rows)


def test_negatives_of_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, 1, [1.0, 2.0]), (0, 1, [1.0, 2.0]), (1, 1, [1.0, 1.9]), (2, 2, [1.0, 1.8]), (2, 3, [1.0, 1.8]), (3, 2, [1.0, nan]), (4, 2, [inf, 1.0]),
            (5, None, [1.0, 2.0]), (None, 2, [1.0, 2.0]), (6, 2, None), (7, 2, [1.0, None]), (8, 2, [2.0]), (9, 1, []), (10, 2, []), (10, 1, [1.0, 2.0]),
            (20, 4, [-1.0, -2.0]), (21, 4, [-1.0, -1.0]), (22, 5, [0.0, 0.0]), (30, 5, [0.0, 0.0])]
    df = vectors(spark, rows).withColumn("id", F.lit(1)).withColumn("q", F.lit("x")).withColumn("rank", F.lit(0))
    got = sorted(map(tuple, negatives.mine(negatives.prepared(df), F.col("id") % 10 == 0).collect()))
    assert got == brute_negatives(rows) and got
    nothing = vectors(spark, [])
    assert negatives.mine(negatives.prepared(nothing), F.col("id") % 10 == 0).collect() == []


def test_packed_products_of_any_width():
    rng = random.Random(4)
    for top in (1, 200, 1 << 20, 1 << 40, 1 << 62):
        block = np.array([[rng.randint(-top, top) for _ in range(6)] for _ in range(33)], dtype=np.int64)
        for anchor in ([rng.randint(-top, top) for _ in range(6)], [0] * 6, [top] * 6, [-top] * 6):
            want = [max(-(1 << 63) + 1, min((1 << 63) - 1, sum(a * int(x) for a, x in zip(anchor, row)))) for row in block]
            assert negatives.Packed(block, top).scores(anchor).tolist() == want


# --- archives

MARKED = "a\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.0\r\n" * 40
PAGES = [(1, "http://a/", "x" * 99), (2, "http://b/", "x" * 99), (3, "http://c/", "é" * 60), (4, None, "é" * 60), (9, "u\r\nX-Page-ID: 7", "é" * 60),
         (5, "http://e/%0A~", None), (6, "", ""), (7, " http://g/ ", MARKED), (8, "http://h/", "y" * 500_000), (8, "http://h/", "y" * 500_000),
         (None, "http://n/", "é" * 60), (None, "http://o/", "z" * 200), (10, "http://p/", "0\r\n\r\n" * 3000), (11, "http://q/", MARKED), (-3, "http://r/", "漢字😀" * 5000)]


def brute_pages(pages):
    first = {}
    for i, _, html in pages:
        if i is not None:
            first[html or ""] = min(first.get(html or "", i), i)
    rows = []
    for i, url, html in pages:
        body = (html or "").encode()
        told = first.get(html or "") if len(body) >= 100 else None
        refers = told if told is not None and (i is None or i > told) else None
        rows.append((i, url or "", len(body), hashlib.sha256(body).hexdigest(), "response" if refers is None else "revisit", refers, None if refers is not None else body))
    return sorted(rows, key=repr)


def got_pages(df):
    rows = df.collect()
    assert all(r.fault is None for r in rows)
    return sorted(((r.page_id, r.uri, r.payload_bytes, r.digest, r.kind, r.refers_to, bytes(r.payload) if r.payload is not None else None) for r in rows), key=repr)


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("digest", F.lit("clash")).withColumn("uri", F.lit(3))


@pytest.mark.parametrize("segment, chunk", [(warc.SEGMENT_BYTES, warc.CHUNK_BYTES), (700, 64), (90, 1)])
def test_pages_come_back(spark, pages, tmp_path, segment, chunk):
    some = pages.where("length(html) < 100000 OR html IS NULL") if chunk == 1 else pages
    rows = [p for p in PAGES if len(p[2] or "") < 100_000] if chunk == 1 else PAGES
    folder = str(tmp_path / "a")
    warc.write(some.repartition(3), folder, segment=segment, chunk=chunk)
    assert got_pages(warc.read(spark, folder)) == brute_pages(rows)
    assert got_pages(warc.read(spark, folder, foreign=True)) == brute_pages(rows)
    assert {r.payload for r in warc.read(spark, folder, payloads=False).collect()} == {None}


def test_hot_payloads(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "HOT_ROWS", 3)
    rows = [(i, "u", "same " * 40) for i in range(50)] + [(100 + i, "u", f"pair {i // 2} " * 30) for i in range(40)]
    folder = str(tmp_path / "h")
    warc.write(spark.createDataFrame(rows, "page_id long, url string, html string"), folder)
    assert got_pages(warc.read(spark, folder)) == brute_pages(rows)


def test_splits_of_a_file(spark, pages, tmp_path):
    """One large file is read by several tasks."""
    folder = str(tmp_path / "s")
    warc.write(pages.repartition(1), folder, segment=5000, compression="none")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9k")
    try:
        read = warc.read(spark, folder)
        assert warc.raw_records(spark, folder).rdd.getNumPartitions() > 20
        assert got_pages(read) == brute_pages(PAGES)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def framed(block, **fields):
    lines = "".join(f"{k.replace('_', '-')}: {v}\r\n" for k, v in fields.items())
    return f"WARC/1.0\r\n{lines}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


HTTP = b"HTTP/1.1 200 OK\r\ntransfer-Encoding: gzip, Chunked\r\n\r\n"


def archive(tmp_path, *files, ending=".warc"):
    for n, data in enumerate(files):
        (tmp_path / f"{n}{ending if n == 0 else '.warc'}").write_bytes(data)
    return str(tmp_path)


@pytest.mark.parametrize("packed", [False, True])
def test_foreign_archives(spark, tmp_path, packed):
    """Marks inside payloads, segments in any order and file, chunk extensions and trailers, plain bodies."""
    plain = b"HTTP/1.0 200 OK\r\n\r\nfirst\r\n\r\nWARC/1.0\r\nContent-Length: 2\r\n\r\nok\r\n\r\nrest"
    whole = HTTP + b"5;a=b\r\nhello\r\nA\r\n, segments\r\n0\r\nx-trailer: 1\r\n\r\n"
    parts = [whole[:60], whole[60:61], whole[61:70], whole[70:]]
    cut = [framed(parts[0], WARC_Type="response", WARC_Record_ID="<o>", X_Page_ID=2, warc_segment_number=1)]
    cut += [framed(p, WARC_Type="continuation", WARC_Record_ID=f"<o{n}>", WARC_Segment_Origin_ID="<o>", WARC_Segment_Number=n,
                   **({"WARC_Segment_Total_Length": len(whole)} if n == 4 else {})) for n, p in enumerate(parts[1:], 2)]
    first = [framed(plain, WARC_Type="response", X_Page_ID=1), cut[3], cut[1]]
    folder = archive(tmp_path, b"".join(map(gzip.compress, first) if packed else first), cut[2] + cut[0], ending=".warc.gz" if packed else ".warc")
    rows = {r.page_id: r for r in warc.read(spark, folder, foreign=True).collect()}
    assert {i: bytes(r.payload) for i, r in rows.items()} == {1: plain.partition(b"\r\n\r\n")[2], 2: b"hello, segments"}
    assert all(r.fault is None for r in rows.values())


def test_broken_records_are_told(spark, tmp_path):
    def seg(origin, number, block, total=None):
        extra = {"WARC_Segment_Total_Length": total} if total is not None else {}
        kind = {"WARC_Record_ID": origin} if number == 1 else {"WARC_Segment_Origin_ID": origin}
        return framed(block, WARC_Type="response" if number == 1 else "continuation", X_Page_ID=len(origin), WARC_Segment_Number=number, **kind, **extra)

    body = HTTP + b"3\r\nabc\r\n0\r\n\r\n"
    records = [seg("1", 1, body[:50]), seg("1", 3, body[50:], len(body)),                                   # gap
               seg("22", 1, body[:50]), seg("22", 2, body[50:]),                                            # no end
               seg("333", 1, body[:50]), seg("333", 2, body[50:], 7),                                       # total length
               seg("4444", 2, body[50:], len(body)),                                                        # no start
               seg("55555", 1, body[:50]), seg("55555", 2, body[50:], len(body)), seg("55555", 2, b"x"),    # repeated
               framed(HTTP + b"2\r\nabc\r\n0\r\n\r\n", X_Page_ID=6), framed(HTTP + b"x\r\nabc", X_Page_ID=7), framed(body[:-2], X_Page_ID=8),
               framed(body, X_Page_ID=9, WARC_Payload_Digest="sha256:00"), b"WARC/1.0\r\nX-Page-ID: 10\r\n\r\n\r\n\r\n", framed(body, X_Page_ID=11)]
    rows = warc.read(spark, archive(tmp_path, b"".join(records))).collect()
    assert len(rows) == 11
    assert [bytes(r.payload) for r in rows if r.fault is None] == [b"abc"]
    assert {r.fault for r in rows if r.fault} == {"segment missing", "last segment missing", "total length differs", "first segment missing", "segment repeated",
                                                  "chunk is longer than its size", "no chunk size", "block ends early", "digest differs", "record is torn"}


def test_empty_archive(spark, pages, tmp_path):
    folder = str(tmp_path / "e")
    warc.write(pages.where("false"), folder)
    assert warc.read(spark, folder).collect() == []


# --- source divergence


def brute_audit(docs):
    counts, having, whole = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in docs:
        lang, source = lang or "", source or ""
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")
        terms = [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in terms]
        counts[lang, source].update(terms)
        whole[lang].update(terms)
        having[lang].update(set(terms))
    out = []
    for lang, source in counts:
        kept = [t for t, n in having[lang].items() if n >= 3]
        p = {}
        for name, c in [(s, counts[l, s]) for l, s in counts if l == lang] + [(None, whole[lang])]:
            total = sum(c[t] for t in kept) + len(kept)
            p[name] = {t: 1 + 10 ** 9 * (c[t] + 1) // total for t in kept}
        own = p[source]
        pairs = [(-sum((own[t] - q[t]) ** 2 // q[t] for t in kept), s) for s, q in p.items() if s not in (source, None)]
        terms = [(-((own[t] - p[None][t]) ** 2 // p[None][t]), t) for t in kept if counts[lang, source][t] and own[t] > p[None][t]]
        for part, items, top in (("pair", pairs, None), ("term", terms, 200)):
            ranked = sorted(items, key=lambda x: (x[0], x[1].encode()))[:top]
            out += [(lang, source, part, item, -v, r) for r, (v, item) in enumerate(ranked, 1)]
    return sorted(out)


def documents(spark, rows):
    return spark.createDataFrame(rows, "lang string, source string, text string")


def test_audit_is_brute_force(spark, monkeypatch):
    rng = random.Random(8)
    words = ["The", "the", "THE", "don't", "é", "É", "漢字", "x1y", "snake_case", "\x7fq", "a\x00b", *(f"w{chr(97 + n % 26)}{chr(97 + n // 26)}" for n in range(300))]
    rows = [(rng.choice(["en", "en", "de", None, ""]), rng.choice(["s0", "s0", "s0", "s1", "s2", None, "", "ß", "z"]),
             " ".join(rng.choices(words, weights=[300 / (n + 1) for n in range(len(words))], k=rng.randrange(60)))) for _ in range(300)]
    rows += [("en", "silent", None), ("en", "silent", ""), ("fr", "only", "too few documents"), ("fr", "other", "1 2 3"), ("it", "alone", "ciao ciao"),
             *[("it", "alone", "ciao")] * 4, ("en", "s1", "long " * 20_000)]
    want = brute_audit(rows)
    df = documents(spark, rows).withColumn("term", F.lit(1)).withColumn("shard", F.lit(2)).withColumn("value", F.lit("v"))
    assert sorted(map(tuple, divergence.audit(df).collect())) == want
    monkeypatch.setattr(divergence, "CELLS", 12)  # stripes of few sources
    assert sorted(map(tuple, divergence.audit(df, postings=50).collect())) == want


def test_audit_of_nothing(spark):
    assert divergence.audit(documents(spark, [])).collect() == []
    assert divergence.audit(documents(spark, [(None, None, None)])).collect() == []
    got = sorted(map(tuple, divergence.audit(documents(spark, [("en", "a", "1"), ("en", "b", None)])).collect()))
    assert got == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]


def test_shares_are_exact():
    rng = random.Random(2)
    for _ in range(2000):
        total = rng.randint(1, 9 * 10 ** 15)
        count = rng.randint(0, total - 1)
        assert int(divergence.share(np.array([count]), total)[0]) == 1 + 10 ** 9 * (count + 1) // total


def test_runs_are_in_order(spark):
    rows = documents(spark, [("en", f"s{n % 3}", f"b a c word{chr(97 + n)}") for n in range(20)]).repartition(2)
    runs = divergence.runs(rows, 4, postings=10).collect()
    assert len({r.shard for r in runs}) > 1
    for r in runs:
        assert [bytes(t) for t in r.terms] == sorted(bytes(t) for t in r.terms) and sum(r.places) == len(r.who) == len(r.counts)
