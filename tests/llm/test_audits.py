"""Archives, source divergence and filter audits against brute force, on odd rows."""

import base64
import hashlib
import os
import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import duckdb
import pytest
from llm_tables import words

from helpcorpus.llm import queries
from helpcorpus.llm.divergence import share, source_divergence
from helpcorpus.llm.filteraudit import filter_audit, row_statistics, term_matrix
from helpcorpus.llm.warc import read_warc, warc_round_trip, write_warc

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("key", ["op11_warc", "op12_source_divergence", "op13_filter_interaction"])
def test_same_rows_as_sql(spark, key):
    con = duckdb.connect()
    for t in ("documents", "labels", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.queries()[key](spark, SF)
    names = sorted(df.columns)
    want = con.sql(queries.oracle_sql()[key])
    assert sorted(want.columns) == names
    at = [want.columns.index(n) for n in names]
    assert sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr) == sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=repr)


@pytest.fixture(scope="module")
def odd(spark):
    """doc_id, text, lang, source, and columns with names that operators use inside."""
    rng = random.Random(4)
    rows = []
    for i in range(120):
        lang = rng.choice(["en", "en", "en", "de", None, "", "fr"])
        text = " ".join(rng.choice(["Alpha", "beta", "GAMMA", "delta-eps", "x1y", "é", "naïve", "日本", "$5", "don't", "a|b", f"w{rng.randrange(40)}"]) for _ in range(rng.choice([0, 1, 3, 30, 250, 600])))
        rows.append((i, text, lang, rng.choice(["s0", "s0", "s0", "s1", "s2", None, ""])))
    rows += [(200 + i, "the same text", "en", "hot") for i in range(60)] + [(7, "the same text", "en", "s1")] * 3
    rows += [(300, None, "en", "s0"), (301, "", "it", "one"), (302, " \t\n ", "it", "one"), (None, "the same text", "en", "s1"), (None, None, None, None)]
    rows += [(303, words(rng, 20_000), "en", "s1"), (304, "rare", "es", "s0"), (305, "words", "es", "s1"), (306, "A" * 5000, "es", "s1")]
    cols = "key string, row string, at int, term string, posts int, n int, chunk int, words string, a int, b int, p int, terms int"
    return spark.createDataFrame([(*r, *["k", "r", 1, "t", 2, 3, 4, "w", 5, 6, 7, 8]) for r in rows], f"doc_id long, text string, lang string, source string, {cols}").repartition(5)


def test_filters(spark, odd):
    labels = spark.createDataFrame([(i, i % 2, int(i % 5 == 0)) for i in range(0, 400, 3)] + [(201, 1, 0), (201, 0, 1), (None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    mark = {}
    for r in labels.collect():
        if r.doc_id is not None:
            g, t = mark.get(r.doc_id, (0, 0))
            mark[r.doc_id] = max(g, int(r.quality == 1)), max(t, int(r.toxic == 1))
    docs = [(r.doc_id, r.text or "", r.lang or "") for r in odd.collect()]
    least = {}
    for i, t, _ in docs:
        if i is not None:
            least[t] = min(least.get(t, i), i)
    fails = []
    for i, t, lang in docs:
        w = [x for x in re.split("[\x20\x09-\x0d]+", t) if x]
        f = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and i > least[t]}
        fails.append((lang, {k for k, v in f.items() if v}, *mark.get(i, (0, 0))))
    want = {}
    for part in {x[0] for x in fails}:
        shapley = Counter()
        for order in permutations("ABCDE"):
            gone = set()
            for s, letter in enumerate(order):
                own = [(j, x) for j, x in enumerate(fails) if x[0] == part and letter in x[1]]
                here = [x for j, x in own if j not in gone]
                shapley[letter] += len(here)
                redundant = len(own) - len(here)
                gone |= {j for j, _ in own}
                kept = sum(x[0] == part for x in fails) - len(gone)
                want[part, "".join(order), s + 1] = [kept, len(here), redundant, sum(len(x[1]) == 1 for _, x in own), sum(x[2] for x in here), sum(x[3] for x in here)]
        for (p, o, s), v in want.items():
            if p == part:
                v.append(shapley[o[s - 1]])
    for sizes in ({}, {"chunk_bytes": 500, "chunk_rows": 7}):
        got = {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in filter_audit(odd, labels, **sizes).collect()}
        assert got == want
    assert filter_audit(odd.limit(0), labels).count() == 0 and filter_audit(odd, labels.limit(0)).where("good_lost > 0").count() == 0


def test_term_matrix(spark, odd):
    from pyspark.sql import functions as F

    dictionary, shards = term_matrix(odd, F.struct("doc_id", "lang"), chunk_bytes=2000, chunk_rows=9)
    term = {bytes(r.word).decode(): r.term for r in dictionary.collect()}
    assert [term[w] for w in sorted(term, key=str.encode)] == list(range(len(term)))
    got, n = Counter(), 0
    for s in shards.collect():
        n += 1
        assert s.indptr[0] == 0 and len(s.indptr) == len(s.rows) + 1 <= 10
        for k, row in enumerate(s.rows):
            cells = range(s.indptr[k], s.indptr[k + 1])
            got[row.doc_id, frozenset((s.indices[c], s.data[c]) for c in cells)] += 1
    want = Counter((r.doc_id, frozenset((term[w], c) for w, c in Counter((r.text or "").encode().decode("utf-8").split()).items())) for r in odd.collect())
    assert got == want and n > 10
    assert sum(r.n_distinct for r in row_statistics(shards).collect()) == sum(len(k[1]) * v for k, v in want.items())


def divergences(rows, least, top):
    """As the operator, term by term."""
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    docs, counts, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, text in rows:
        found = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", text.translate(low))
        groups[lang].add(source)
        docs[lang].update(set(found))
        counts[lang, source].update(found)
    out = set()
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= least]
        v, every = len(kept), Counter()
        for s in sources:
            every.update({t: counts[lang, s][t] for t in kept})
        shares = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c[x] for x in kept) + v) for t in kept}
        q = shares(every)
        p = {s: shares(counts[lang, s]) for s in sources}
        f = lambda a, b: (a - b) * (a - b) // b
        for s in sources:
            pairs = [(o, sum(f(p[s][t], p[o][t]) for t in kept)) for o in sources if o != s]
            terms = [(t, f(p[s][t], q[t])) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out |= {(lang, s, part, item, value, i + 1) for i, (item, value) in enumerate(found[:most])}
    return out


def test_divergence(spark, odd):
    rows = [(r.lang or "", r.source or "", r.text or "") for r in odd.collect()]
    for least, top, cells in ((3, 200, 300_000), (1, 5, 3)):  # small cells: counts and accumulators are handed on often
        got = source_divergence(odd, least, top, cells=cells).collect()
        want = divergences(rows, least, top)
        assert {tuple(r) for r in got} == want and len(got) == len(want)
    pairs = {(r.lang, r.source, r.item): r.value for r in got if r.part == "pair"}
    assert ("es", "s0", "s1") in pairs and not any(lang == "it" for lang, _, _ in pairs)
    assert source_divergence(odd.limit(0)).count() == 0
    none = [r.value for r in source_divergence(odd, 10**6).collect()]
    assert none and set(none) == {0}  # no kept terms


def test_shares_of_large_counts(spark):
    from pyspark.sql import functions as F

    cases = [(0, 0, 0), (0, 5, 3), (4, 5, 3), (10**13, 3 * 10**13, 10**7), (9 * 10**9, 9 * 10**9 + 1, 5), (8999999999, 10**17, 77), (10**17, 10**17, 1)]
    d = spark.createDataFrame(cases, "n long, of long, terms long").withColumn("p", share(F.col("n"), F.col("of"), F.col("terms")))
    assert [r.p for r in d.collect()] == [1 + 10**9 * (n + 1) // max(1, of + v) for n, of, v in cases]


def digest(data):
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def archive(*blocks, version="1.0"):
    """A file of resource records."""
    return b"".join(f"WARC/{version}\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:x:{i}>\r\ncontent-length:  {len(b)}\r\n\r\n".encode() + b + b"\r\n\r\n" for i, b in enumerate(blocks))


@pytest.fixture(scope="module")
def pages(spark):
    rng = random.Random(6)
    fake = archive(b"a false record", b"and another").decode()
    html = [words(rng, rng.choice([0, 1, 50, 900])) for _ in range(60)]
    html += [fake, "before " + fake + " after", "WARC/1.", "WARC/1.1\r\nContent-Length: 5\r\n\r\n", "WARC/1.0\r\nA: b\r\nContent-Length: 9999999\r\n\r\nx", "x" * 3 + fake * 40, None, "", "", "\r\n\r\n", "é日本\x00\x01", words(rng, 20_000)]
    html += ["copy"] * 30 + [html[65]] * 2
    rows = [(i, f"http://h/{i} WARC/1.1\r\nX: y" if i % 7 == 0 else None if i % 7 == 1 else f"http://h/{i}", h) for i, h in enumerate(html)]
    rows += [(rows[80][0], rows[80][1], "copy")] * 3 + [(None, "u", "copy"), (None, "u", "alone"), (None, None, "both"), (None, None, "both")]
    cols = "digest string, page int, n int, file string, off int, block int, head string"
    return spark.createDataFrame([(*r, "d", 1, 2, "f", 3, 4, "h") for r in rows], f"page_id long, url string, html string, {cols}").repartition(3)


def want_records(pages, least):
    groups = defaultdict(list)
    for r in pages.collect():
        groups[(r.html or "").encode()].append(r.page_id)
    out = Counter()
    for data, ids in groups.items():
        first = max(ids, key=lambda i: (i is not None, i))
        for k, i in enumerate(sorted(ids, key=lambda i: i != first)):
            again = k > 0 and len(data) >= least
            out[i, len(data), digest(data), "revisit" if again else "response", first if again else None] += 1
    return out


@pytest.mark.parametrize(("split", "least"), [("128m", 0), ("3000b", 0), ("700b", 5), ("128m", 10**6)])
def test_round_trip(spark, pages, split, least):
    keep = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        spark.conf.set("spark.sql.files.openCostInBytes", "1b")
        out = warc_round_trip(pages, least).collect()
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)
    assert Counter(tuple(r) for r in out) == want_records(pages, least)


def test_round_trip_of_nothing(spark, pages):
    assert warc_round_trip(pages.limit(0)).count() == 0


def test_reading(spark, pages, tmp_path):
    """Files of others, with and without HTTP heads, false records, a wrong length and a cut end, in splits of every size."""
    blocks = [b"one", archive(b"false", b"too"), b"", b"HTTP/1.1 200 OK\r\n\r\nno http by its type", b"WARC/1.", "é\udcff".encode("utf-8", "surrogateescape") * 30]
    good = archive(*blocks)
    files = {"good": good, "more": archive(*[b"%d" % i * (i % 50) for i in range(300)], version="1.1"), "cut": archive(b"whole", b"x" * 500)[:-200], "wrong": archive(b"whole") + b"WARC/1.0\r\nContent-Length: 3\r\n\r\nlonger\r\n\r\n" + archive(b"lost"), "junk": b"junk" + archive(b"lost"), "empty": b""}
    os.mkdir(tmp_path / "w")
    for name, data in files.items():
        (tmp_path / "w" / f"{name}.warc").write_bytes(data)
    keep = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for split in ("128m", "97b", "400b", "1000b"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", split)
            spark.conf.set("spark.sql.files.openCostInBytes", "1b")
            got = defaultdict(list)
            for r in read_warc(spark, str(tmp_path / "w")).orderBy("off").collect():
                assert r.digest == digest(bytes(r.payload)) and r.payload_bytes == len(r.payload)
                got[r.file.rsplit("/", 1)[1][:-5]].append((bytes(r.payload), r.whole))
            assert got["good"] == [(b, True) for b in blocks]
            assert got["more"] == [(b"%d" % i * (i % 50), True) for i in range(300)]
            assert got["cut"] == [(b"whole", True), (b"x" * 304, False)] and got["wrong"][0] == (b"whole", True) and len(got["wrong"]) == 2
            assert set(got) == {"good", "more", "cut", "wrong"}
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)
    write_warc(pages, str(tmp_path / "p"))
    html = Counter((r.html or "").encode() for r in pages.collect())
    assert Counter(bytes(r.payload) for r in read_warc(spark, str(tmp_path / "p")).where("record_type = 'response'").collect()) == Counter(set(html))
