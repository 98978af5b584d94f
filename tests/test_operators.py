"""Small cases with known results."""

import os
import random
import time

import pytest
from pyspark.sql import functions as F

from helpcorpus.functions.scalars import context_hash, external_path, fold_text, hash_weight, html_escape, js_string, linked_identity, relative_only, topic_label
from helpcorpus.operators import contents as C
from helpcorpus.operators import export as X
from helpcorpus.operators import keywords as K
from helpcorpus.operators import links as L
from helpcorpus.operators import macros as M
from helpcorpus.operators import resolve as R
from helpcorpus.operators import search as S
from helpcorpus.operators import sessions as N
from helpcorpus.operators import topics as T
from helpcorpus.sources import ingest as I


def values(spark, column, *texts):
    return [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(column).collect()]


def test_context_hash(spark):
    h = lambda s: __import__("functools").reduce(lambda a, b: (a * 43 + hash_weight(b)) & 0xFFFFFFFF, s.encode(), 0)
    names = ["Getting_Started", "getting_started", "topic.one", "topic.two", "", None, "é" * 30]
    got = values(spark, context_hash(F.col("t")), *names)
    assert got[0] == got[1] and got[2] != got[3] and got[4] == 1 and got[5] is None
    want = h(names[6])
    assert got[6] == (want - (1 << 32) if want >> 31 else want)


def test_scalars(spark):
    assert values(spark, fold_text(F.col("t")), "  A\t\nB ", None) == ["a b", None]
    assert values(spark, html_escape(F.col("t")), "<a b='\"'>&lt;") == ["&lt;a b=&#39;&quot;&#39;&gt;&amp;lt;"]
    assert values(spark, js_string(F.col("t")), 'a"\\</script>\n\x01') == ['"a\\"\\\\\\u003C/script\\u003E\\n\\u0001"']
    assert values(spark, relative_only(F.col("t")), "a/b.hlp", "/a", "\\\\srv\\a", "C:a", " ", None) == [True, False, False, False, False, False]
    assert values(spark, external_path(F.lit("docs/current.hlp"), F.col("t")), "related\\other.hlp", "/x") == ["docs/related/other.hlp", "/x"]
    assert values(spark, topic_label(F.col("t"), F.lit(4)), " ", None, " x ") == ["Topic 5", "Topic 5", "x"]


def test_asof_join(spark):
    anchors = spark.createDataFrame([("a", 100, 0, 1), ("a", 100, 1, 2), ("a", 32768, 2, 3), ("b", 5, 9, 4)], "doc string, topic_offset long, topic_index int, pos long")
    refs = spark.createDataFrame([(1, "a", 99), (2, "a", 100), (3, "a", 32767), (4, "a", 40000), (5, "a", 65536), (6, "a", -1), (7, "b", 6), (8, "c", 6), (9, "a", None), (2, "a", 100)], "ref_id int, doc string, topic_offset long")
    got = sorted((r.ref_id, r.topic_index) for r in R.resolve_topic_offset(refs, anchors).collect())
    assert got == [(1, None), (2, 1), (2, 1), (3, 1), (4, 2), (5, None), (6, None), (7, 9), (8, None), (9, None)]
    contexts = spark.createDataFrame([("a", 1, 7, 100), ("a", 0, 7, 40000)], "doc string, ord int, hash int, topic_offset long")
    hit = R.resolve_context_hash(spark.createDataFrame([("a", 7), ("a", 8)], "doc string, hash int"), contexts, anchors)
    assert sorted((r.hash, r.topic_index) for r in hit.collect()) == [(7, 2), (8, None)]  # the first of the list wins


def test_search(spark):
    topics = spark.createDataFrame([("d", 0, "Installing", "ordinary setup discussion"), ("d", 1, "Other", "installing appears in body"), ("d", 2, "Networking", "configure the adapter before network setup")], "doc string, topic_index int, title string, plain_text string")
    kw = spark.createDataFrame([("d", 0, ["install"])], "doc string, topic_index int, folded_keywords array<string>")
    t = S.build_search_table(topics, kw)
    run = lambda q: [(r.topic_index, r.score, r.kind) for r in S.search_topics_in(t, q).orderBy("rank").collect()]
    assert run(" INSTALL ") == [(0, 950, "Keyword"), (1, 407, "Body")]
    assert run("adapter setup") == [(2, 310, "Body")] and run("  ") == [] and run("%") == []
    q = spark.createDataFrame([(i, x) for i, x in enumerate(["install", "adapter setup", " ", None, "networking"])], "query_id int, query string")
    want = [(0, 1, 0, 950), (0, 2, 1, 407), (1, 1, 2, 310), (4, 1, 2, 1000)]
    assert sorted((r.query_id, r.rank, r.topic_index, r.score) for r in S.search_batch(t, q, 10).collect()) == want
    assert [r.label for r in S.search_corpus(t, "install").collect()] == ["[Keyword] Installing — d", "[Text] Other — d"]


def test_keywords(spark):
    kw = spark.createDataFrame([("d", "A", 0, "FIRST", [10, 20]), ("d", "A", 1, "SECOND", [20, 30, -1])], "doc string, table_id string, ord int, keyword string, offsets array<long>")
    look = lambda names: [r.topic_offset for r in K.keyword_exact_lookup(spark.createDataFrame([(1, "d", "a", names)], "lookup int, doc string, table_id string, names string"), kw).orderBy("rank").collect()]
    assert look("FIRST; SECOND") == [10, 20, 30] and look("SECOND;FIRST") == [20, 30, 10] and look("first") == []
    assert K.keyword_table_profile(kw).first()[2:] == (2, 4, 1)


CONTENTS = [":Title Manual", ":Base manual.hlp>main", ":Index Glossary=terms.hlp", ":Link more.hlp", "1 Book", "2 Topic=start", "2 External=install@setup.hlp>steps"]


def test_search_batch_finds_every_match(spark):
    """Against the single search of each query: parts of words, short terms, terms nowhere, terms over blanks, odd characters."""
    rng = random.Random(11)
    piece = lambda n: "".join(rng.choice("abcé𝄞 ") for _ in range(n))
    rows = [("d", i, piece(8), piece(rng.choice([0, 20, 60]))) for i in range(60)]
    kw = spark.createDataFrame([("d", i, [piece(5).strip() or "a", "cab"]) for i in range(0, 60, 3)], "doc string, topic_index int, folded_keywords array<string>")
    t = S.build_search_table(spark.createDataFrame(rows, "doc string, topic_index int, title string, plain_text string"), kw).cache()
    queries = list(enumerate([piece(rng.choice([1, 2, 3, 4, 6, 9])) for _ in range(25)] + ["cab", "zzz", "a zzz", "b  a", "  ", None]))
    got = {}
    for r in S.search_batch(t, spark.createDataFrame(queries, "query_id int, query string"), 5).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.topic_index, r.score, r.kind))
    for i, q in queries:
        want = [(r.rank, r.topic_index, r.score, r.kind) for r in S.search_topics_in(t, q, 5).orderBy("rank").collect()] if q else []
        assert sorted(got.get(i, [])) == want, q
    assert len(got) > 10


def test_search_batch_leaves_texts_in_place(spark):
    """A large table of queries is taken in slices with the same rows, and no text is shuffled, whatever its size."""
    rows = [("d", i, f"Title {i % 5}", f"the adapter {i % 7} before network{i % 3} setup") for i in range(40)]
    kw = spark.createDataFrame([("d", i, ["two words", f"key{i % 4}"]) for i in range(0, 40, 2)], "doc string, topic_index int, folded_keywords array<string>")
    t = S.build_search_table(spark.createDataFrame(rows, "doc string, topic_index int, title string, plain_text string"), kw).localCheckpoint()
    q = spark.createDataFrame([(i, x) for i, x in enumerate(["title", "key1", "two w", "the setup", "adapter 3", "network1 setup", "o", "e b", "nowhere"])], "query_id int, query string")
    want = sorted(S.search_batch(t, q, 4).collect())
    assert want and want == sorted(S.search_batch(t, q, 4, slice_bytes=100).collect())
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = S.search_batch(t, q, 4)._jdf.queryExecution().toString()
        plan = plan[plan.index("== Physical Plan") :]
        assert "Exchange hashpartitioning(query_id" in plan and "hashpartitioning(doc" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def lines(spark, texts):
    return spark.createDataFrame([("d", i, t) for i, t in enumerate(texts)], "doc string, line long, text string")


def test_contents(spark, tmp_path):
    got = I.read_contents_lines(lines(spark, CONTENTS)).orderBy("line")
    assert [tuple(r)[2:] for r in got.collect()] == [(1, "Book", None, None, None), (2, "Topic", "start", None, None), (2, "External", "install", "setup.hlp", "steps")]
    bad = lines(spark, ["0 Invalid", ":Unknown thing", "1 Valid=topic", "no digits", "; remark", "99999999999 Far", ":Base"])
    assert I.read_contents_lines(bad).count() == 1
    assert [r.warning for r in I.contents_warnings(bad).orderBy("line").collect()] == ["level 0", "unsupported directive :unknown", "level out of range", "empty :base"]
    h = C.contents_hierarchy(got)
    assert [(r.parent_line, r.depth, r.has_children) for r in h.orderBy("line").collect()] == [(None, 0, True), (4, 1, False), (4, 1, False)]
    assert [r.path for r in C.contents_paths(h).orderBy("line").collect()] == ["Book", "Book / Topic", "Book / External"]
    (tmp_path / "a.cnt").write_text("\r\n".join(CONTENTS))
    assert I.read_contents_lines(I.contents_lines(spark, str(tmp_path / "a.cnt"))).count() == 3
    more = lines(spark, [":Title One", ":title Two", ":Title", ":Base b.hlp > main", ":Index = x.hlp", ":index Terms=c:\\h\\t.hlp", ":LINK y.hlp", ":Link"])
    assert [tuple(r) for r in I.contents_meta(more).collect()] == [("d", "Two", "b.hlp", "main")]
    assert [tuple(r)[2:] for r in C.contents_links(I.contents_link_rows(more)).orderBy("ord").collect()] == [("index", None, "x.hlp"), ("index", "Terms", "t.hlp"), ("search", None, "y.hlp")]


def test_hierarchy_is_a_stack(spark, monkeypatch):
    rng = random.Random(2)
    rows = [("d", i, rng.randint(1, 6), f"t{i}") for i in range(80)]
    stack, want = [], {}
    for _, i, level, _ in rows:
        while stack and stack[-1][1] >= level:
            stack.pop()
        want[i] = (stack[-1][0] if stack else None, len(stack))
        stack.append((i, level))
    d = spark.createDataFrame(rows, "doc string, line long, level int, title string")
    assert {r.line: (r.parent_line, r.depth) for r in C.contents_hierarchy(d).collect()} == want
    monkeypatch.setattr(C, "LEVELS", 3)
    assert {r.line: r.parent_line for r in C.contents_hierarchy(d).collect()} == {k: v[0] for k, v in want.items()}


def test_hierarchy_of_many_levels(spark):
    rng = random.Random(4)
    rows = [("few", i, 1 + i % 3, f"f{i}") for i in range(9)]
    rows += [("many", i, rng.randint(1, 65535), f"m{i}") for i in range(200)] + [("deep", i, 5 + 7 * i, f"d{i}") for i in range(90)]
    want, path = {}, {}
    for doc in ("few", "many", "deep"):
        stack = []
        for _, i, level, title in (r for r in rows if r[0] == doc):
            while stack and stack[-1][1] >= level:
                stack.pop()
            want[doc, i] = (stack[-1][0] if stack else None, len(stack))
            path[doc, i] = " / ".join([t for _, _, t in stack] + [title])
            stack.append((i, level, title))
    h = C.contents_hierarchy(spark.createDataFrame(rows, "doc string, line long, level int, title string"))
    assert {(r.doc, r.line): (r.parent_line, r.depth) for r in h.collect()} == want
    assert {(r.doc, r.line): r.path for r in C.contents_paths(h).collect()} == path


def test_hierarchy_writes_nothing(spark):
    """Depths and parents come from one stream of a document's rows, not from rounds of checkpoints; rows without a document, line or level stand alone."""
    rows = [("deep", i, i + 1, f"t{i}") for i in range(300)] + [(None, 1, 1, "x"), (None, 2, 2, "y"), ("odd", 1, 1, "a"), ("odd", 2, None, "b"), ("odd", 3, 2, None), ("odd", None, 1, "c")]
    files = lambda: sum(len(f) for _, _, f in os.walk(spark.conf.get("spark.checkpoint.dir")))
    before = files()
    got = {(r.doc, r.line): (r.parent_line, r.depth) for r in C.contents_hierarchy(spark.createDataFrame(rows, "doc string, line long, level int, title string").repartition(5)).collect()}
    want = {("deep", i): (i - 1 if i else None, i) for i in range(300)} | {(None, 1): (None, 0), (None, 2): (None, 0), ("odd", 1): (None, 0), ("odd", 2): (None, 0), ("odd", 3): (1, 1), ("odd", None): (None, 0)}
    assert got == want and files() == before


def test_deep_paths_are_never_written(spark, monkeypatch):
    """Paths of a deep document are many times its rows; chunks of few rows get their ancestors."""
    monkeypatch.setattr(C, "CHUNK", 64)
    rng = random.Random(6)
    rows = [("deep", 3 * i, max(1, i + 1 - (rng.randrange(40) if i % 5 == 0 else 0)), f"title {i}") for i in range(1500)] + [("flat", i, 1 + i % 2, f"t{i}") for i in range(200)]
    stack, want = [], {}
    for doc, i, level, title in rows:
        while stack and (stack[-1][0] != doc or stack[-1][1] >= level):
            stack.pop()
        want[doc, i] = " / ".join([t for _, _, t in stack] + [title])
        stack.append((doc, level, title))
    h = C.contents_hierarchy(spark.createDataFrame(rows, "doc string, line long, level int, title string"))
    size = lambda: sum(os.path.getsize(os.path.join(at, f)) for at, _, files in os.walk(spark.conf.get("spark.checkpoint.dir")) for f in files)
    before = size()
    assert {(r.doc, r.line): r.path for r in C.contents_paths(h).collect()} == want
    assert size() - before < sum(map(len, want.values())) / 10


def test_records(spark):
    r = spark.createDataFrame([("d", 160, None, 100, None, 0x20, "second\0"), ("d", 128, 130, 150, 170, 0x20, "first"), ("d", 90, 90, None, None, 0x20, "fixed"), ("d", 99, None, None, None, 2, "none")], "doc string, pos long, non_scroll long, scroll long, next_topic long, record_type int, payload string")
    out = {x.pos: (x.region, x.text) for x in T.record_text(T.classify_region(r)).collect()}
    assert out == {160: ("scrolling", "second"), 128: ("unclassified", "first"), 90: ("non_scrolling", "fixed"), 99: ("scrolling", "")}
    body, warnings = T.recover_unclassified(T.classify_region(r), ["doc"])
    assert [x.pos for x in body.orderBy("pos").collect()] == [128, 160] and warnings.first().warning == "recovered 1"
    shown = spark.createDataFrame([("d", 0, 0), ("d", 1, 1), ("e", 3, 0)], "doc string, topic_index int, n_visible int")
    assert sorted(tuple(x) for x in T.startup_topic(shown).collect()) == [("d", 1), ("e", 3)]


def test_headers(spark):
    import struct

    files = [(n, bytearray(struct.pack("<IIiI", *h) + b"x" * 100)) for n, h in (("ok", (0x35F3F, 20, -1, 100)), ("other", (0x24E4C, 20, -1, 100)), ("bad", (1, 20, -1, 100)), ("big", (0x35F3F, 20, -1, 1000)), ("dir", (0x35F3F, 4, -1, 100)), ("free", (0x35F3F, 20, 5, 100)))]
    out = I.triage_headers(I.header_fields(spark.createDataFrame(files, "name string, content binary")))
    odd = [(n, bytearray(struct.pack("<IIiI", *h))) for n, h in enumerate([(0x35F3F, 0xA9C3, -2, 0x98ADE2), (0xFFFFFFFF, 0xC3A9, -(1 << 31), 0x80808080)])] + [(2, bytearray(b"?_\x03"))]
    got = I.header_fields(spark.createDataFrame(odd, "n int, content binary")).orderBy("n").collect()
    assert [tuple(r)[2:] for r in got] == [(0x35F3F, 0xA9C3, -2, 0x98ADE2, 16), (0xFFFFFFFF, 0xC3A9, -(1 << 31), 0x80808080, 16), (None, None, None, None, 3)]
    cut = spark.createDataFrame([(1, bytearray(struct.pack("<II", 0x35F3F, 20))), (2, bytearray(b""))], "n int, content binary")
    assert {r.n: r.verdict for r in I.triage_headers(I.header_fields(cut)).collect()} == {1: "header cut short", 2: "header cut short"}
    assert {r.name: r.verdict for r in out.collect()} == {"ok": "ok", "other": "other family", "bad": "bad magic", "big": "size beyond file", "dir": "directory out of bounds", "free": "free list out of bounds"}


def test_scan(spark, tmp_path):
    for n in ("a.HLP", "b.mvb", "c.txt"):
        (tmp_path / n).write_bytes(b"12345")
    assert sorted(r.doc.split("/")[-1] for r in I.scan_corpus_files(spark, str(tmp_path)).collect()) == ["a.hlp", "b.mvb"]


def test_links(spark):
    refs = spark.createDataFrame([("a", 1, "B"), ("a", 2, "c"), ("b", 1, "a"), ("c", 1, "d"), ("c", 2, "/x"), ("d", 1, "gone")], "doc string, rank int, help_file string")
    docs = spark.createDataFrame([(x,) for x in "abcd"], "doc string")
    seeds = spark.createDataFrame([("a",)], "doc string")
    reached, warnings = L.linked_file_closure(seeds, refs, docs)
    assert sorted((r.rank, r.doc, r.hop) for r in reached.collect()) == [(1, "a", 0), (2, "b", 1), (3, "c", 1), (4, "d", 2)]
    assert sorted((r.doc, r.warning) for r in warnings.collect()) == [("c", "skipped: not a relative path"), ("d", "skipped: cannot be opened")]
    reached, warnings = L.linked_file_closure(seeds, refs, docs, 2)
    assert sorted(r.doc for r in reached.collect()) == ["a", "b"] and "skipped: over the limit" in {r.warning for r in warnings.collect()}


def test_paths(spark):
    cases = [("lib/a.hlp", "b.hlp", "lib/b.hlp"), ("lib/a.hlp", "lib\\b.hlp", "lib/lib/b.hlp"), ("LIB\\a.hlp", "..\\B.hlp", "b.hlp"), ("a.hlp", "../b", "../b"), ("x/y/a", "./../../../b", "../b"), ("lib/a.hlp", None, "lib/a.hlp"), ("lib/A.hlp", " ", "lib/a.hlp"), ("lib/a", "/B//c", "/b/c"), ("lib/a", "C:\\x", "c:/x"), ("lib/a", "", "lib/a"), ("/r/a", "../../b", "/../b")]
    d = spark.createDataFrame([c[:2] for c in cases], "doc string, file string").select(linked_identity(F.col("doc"), F.col("file")))
    assert [r[0] for r in d.collect()] == [c[2] for c in cases]


def test_links_by_folder(spark):
    """A file of the same folder, one named from the root, none, blank and dotted ones; through hotspots, closure and catalog."""
    docs = spark.createDataFrame([("lib/a.hlp",), ("Lib\\B.hlp",), ("b.hlp",)], "doc string")
    files = ["b.hlp", "lib\\b.hlp", None, "  ", "./B.hlp", "../b.hlp", "/b.hlp"]
    spots = spark.createDataFrame([("lib/a.hlp", 0, i, "External", 12, None, True, 226 + i % 2, f, None, 1 if i == 1 else None) for i, f in enumerate(files)] + [("lib/a.hlp", 0, 20, "Internal", 12, None, True, None, "b.hlp", "x", 3), ("lib/a.hlp", 0, 21, "ContextHash", None, 12, False, None, None, None, None), ("lib/a.hlp", 0, 22, "Internal", 5, None, False, None, None, None, None)],
        "doc string, topic_index int, seq int, kind string, topic_offset long, hash int, popup boolean, opcode int, help_file string, win_name string, win_number int")
    anchors = spark.createDataFrame([(d, 12, n, 12) for n, d in enumerate(("lib/a.hlp", "Lib\\B.hlp", "b.hlp"))], "doc string, topic_offset long, topic_index int, pos long")
    contexts = spark.createDataFrame([], "doc string, ord int, hash int, topic_offset long")
    defaults = spark.createDataFrame([("b.hlp", 0, 12, 1), ("lib/a.hlp", 0, 12, 0)], "doc string, ord int, topic_offset long, win int")
    windows = spark.createDataFrame([(d, i, w) for d in ("lib/a.hlp", "b.hlp") for i, w in enumerate(("main", "side"))], "doc string, ordinal int, name string")
    out = {r.seq: (r.dst_doc, r.dst_topic, r.popup, r.mode, r.win) for r in L.resolve_hotspots(spots, contexts, anchors, docs, defaults, windows).collect()}
    lib_b, own = ("Lib\\B.hlp", 1), ("lib/a.hlp", 0)
    assert out[0] == (*lib_b, True, "popup", None) and out[1] == (None, None, False, None, None) and out[2] == (*own, True, "popup", None) and out[3] == (*own, False, "main", None)
    assert out[4] == (*lib_b, True, "popup", None) and out[5] == ("b.hlp", 2, False, "secondary", 1) and out[6][:2] == (None, None)
    assert out[20] == (*own, True, "popup", None) and out[21] == (*own, False, "main", None) and out[22] == ("lib/a.hlp", None, False, None, None)
    refs = spark.createDataFrame([("lib/a.hlp", i, f) for i, f in enumerate(files)], "doc string, rank int, help_file string")
    reached, warnings = L.linked_file_closure(spark.createDataFrame([("LIB/a.hlp",)], "doc string"), refs, docs)
    assert sorted((r.rank, r.doc) for r in reached.collect()) == [(1, "lib/a.hlp"), (2, "Lib\\B.hlp"), (3, "b.hlp")]
    assert sorted((r.help_file, r.warning[9:]) for r in warnings.collect()) == [("/b.hlp", "not a relative path"), ("lib\\b.hlp", "cannot be opened")]
    links = spark.createDataFrame([("lib/a.hlp", i, "search" if f == "../b.hlp" else "index", f) for i, f in enumerate(["A.hlp", *files])], "doc string, ord int, kind string, help_file string")
    found, warnings = L.related_catalog(links, docs)
    assert sorted((r.rank, r.related_doc) for r in found.collect()) == [(1, "Lib\\B.hlp"), (3, "b.hlp")]  # itself is no try
    assert sorted((r.rank or 0, r.help_file or "", r.warning[9:]) for r in warnings.collect()) == [(0, "", "not a relative path"), (0, "  ", "not a relative path"), (0, "/b.hlp", "not a relative path"), (2, "lib\\b.hlp", "cannot be opened")]
    found, warnings = L.related_catalog(links, docs, 1)
    assert found.count() == 1 and [(r.rank, r.help_file) for r in warnings.where("rank > 1").collect()] == [(2, None)]


def test_references_to_one_place_are_spread(spark):
    """Rows do not pass a window, and one place's references go to every copy of its cell."""
    anchors = spark.createDataFrame([("a", 100, 7, 1)], "doc string, topic_offset long, topic_index int, pos long")
    refs = spark.range(20_000).select(F.col("id").alias("ref_id"), F.lit("a").alias("doc"), F.when(F.col("id") % 10 < 9, F.lit(150)).otherwise(F.col("id") % 3 - 2).alias("topic_offset"))
    got = R.resolve_topic_offset(refs, anchors, copies=8)
    assert {(r.topic_index, r.n) for r in got.groupBy("topic_index").agg(F.count(F.lit(1)).alias("n")).collect()} == {(7, 18_000), (None, 2_000)} and got.columns == ["ref_id", "doc", "topic_offset", "topic_index"]
    spans = {(r._copy, r._cell) for r in R._spans(anchors, "t", 8).collect()}
    assert spans == {(s, c) for s in range(8) for c in range(32768 // R.CELL)} and R._spans(anchors, "t").count() == 128


def test_asof_join_against_brute_force(spark):
    rng = random.Random(12)
    anchors = [(rng.choice("ab"), rng.choice([rng.randrange(700), 32768 * rng.randrange(3) + rng.randrange(32768)]), i, rng.randrange(10**6)) for i in range(300)]
    refs = [(i, rng.choice(["a", "b", "c", None]), rng.choice([None, -5, rng.randrange(900), rng.randrange(4 * 32768)])) for i in range(1500)]
    want = {}
    for i, doc, at in refs:
        near = [(o, p, t) for d, o, t, p in anchors if d == doc and at is not None and 0 <= o <= at and o // 32768 == at // 32768]
        want[i] = max(near)[2] if near else None
    got = R.resolve_topic_offset(spark.createDataFrame(refs, "ref_id int, doc string, topic_offset long"), spark.createDataFrame(anchors, "doc string, topic_offset long, topic_index int, pos long"))
    assert {r.ref_id: r.topic_index for r in got.collect()} == want and got.count() == 1500


def test_hit(spark):
    rng = random.Random(7)
    rects = [("d", p, i, i, rng.randrange(-50, 900), rng.randrange(-50, 900), rng.choice([0, 1, 20, 64, 65, 700, 100_000]), rng.choice([1, 30, 64, 300])) for i in range(60) for p in (0, 1)]
    points = [(3 * i + p, "d", p, rng.randrange(-60, 1000), rng.randrange(-60, 1000)) for i in range(150) for p in (0, 1, 2)]
    got = L.hit_test(spark.createDataFrame(points, "point_id long, doc string, picture int, px long, py long"), spark.createDataFrame(rects, "doc string, picture int, rect_id long, ord long, x long, y long, w long, h long"), ["doc", "picture"])
    want = {i: max((r[2] for r in rects if r[1] == p and r[4] <= x < r[4] + r[6] and r[5] <= y < r[5] + r[7]), default=None) for i, _, p, x, y in points}
    assert {r.point_id: r.rect_id for r in got.collect()} == want and any(want.values())


def test_hit_among_many_rectangles_over_each_other(spark):
    """Places times rectangles would be 4 * 10^10 rows here."""
    rects = spark.range(200_000).select(F.lit("d").alias("doc"), F.lit(0).alias("picture"), F.col("id").alias("rect_id"), F.col("id").alias("ord"), (F.col("id") % 5).alias("x"), (F.col("id") % 7).alias("y"), F.lit(40).alias("w"), F.lit(50).alias("h"))
    points = spark.range(200_000).select(F.col("id").alias("point_id"), F.lit("d").alias("doc"), F.lit(0).alias("picture"), (F.col("id") % 41).alias("px"), (F.col("id") % 50).alias("py"))
    last = {(x, y): max(i for i in range(199_900, 200_000) if i % 5 == x and i % 7 == y) for x in range(5) for y in range(7)}
    want = {(px, py): max((i for (x, y), i in last.items() if x <= px < x + 40 and y <= py < y + 50), default=None) for px in range(41) for py in range(50)}
    got = L.hit_test(points, rects, ["doc", "picture"])
    assert got.count() == 200_000
    assert {(r.point_id % 41, r.point_id % 50): r.rect_id for r in got.collect()} == want


def test_phrases_are_a_documents_own(spark):
    tokens = spark.createDataFrame([(d, r, 1, 1, None, False, 3) for d, r in (("a", 1), ("b", 2), ("c", 3))], "doc string, rec int, seq int, phrase_id int, literal string, space boolean, expected int")
    phrases = spark.createDataFrame([("a", 1, "one"), ("b", 1, "two")], "doc string, phrase_id int, phrase string")
    assert sorted(tuple(x) for x in T.expand_phrases(tokens, phrases, ["doc", "rec"]).collect()) == [("a", 1, "one", "ok"), ("b", 2, "two", "ok"), ("c", 3, "", "missing phrase")]


def test_streams_keep_odd_places(spark, tmp_path):
    """Null, empty and oddly named places, over two micro-batches."""
    from pyspark.sql import functions as F

    from helpcorpus.streaming.sessions import stream_history, stream_recent_documents

    events = [[(1, 1, 1, "visit", "A\x1fB"), (1, 2, 2, "visit", None), (1, 3, 3, "visit", "")], [(1, 4, 4, "back", None), (1, 5, 5, "visit", "c"), (2, 6, 6, "visit", None)]]
    for i, rows in enumerate(events):
        spark.createDataFrame(rows, "usr long, ts long, event_id long, action string, location string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"{i}"))
    for f in (stream_recent_documents, stream_history):
        stream = spark.readStream.schema("usr long, ts long, event_id long, action string, location string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
        out = str(tmp_path / f.__name__)
        sink = lambda df, batch: df.withColumn("batch", F.lit(batch)).write.mode("append").parquet(out)  # noqa: B023, E731
        mode = "update" if f is stream_recent_documents else "append"
        f(stream).writeStream.outputMode(mode).option("checkpointLocation", out + "-at").trigger(availableNow=True).foreachBatch(sink).start().awaitTermination()
        rows = spark.read.parquet(out).collect()
        if f is stream_recent_documents:
            last = max(r.batch for r in rows if r.usr == 1)
            assert [r.doc for r in sorted((r for r in rows if r.batch == last and r.usr == 1), key=lambda r: r.rank)] == ["c", "", "a\x1fb"] and not [r for r in rows if r.usr == 2]
        else:
            batch = replayed_places([e for rows in events for e in rows if e[0] == 1])
            assert [(r.current, r.back_depth, r.forward_depth) for r in sorted(rows, key=lambda r: r.event_id) if r.usr == 1] == batch


def test_history_state_is_read_and_written_once():
    """For a user and micro-batch, with rows and no frames."""
    from pyspark.sql import Row

    from helpcorpus.streaming.sessions import HistoryProcessor

    calls, kept = [], {}

    class Value:
        def get(self):
            calls.append("get")
            return kept.get("x")

        def update(self, x):
            calls.append("update")
            kept["x"] = x

    class Handle:
        def getValueState(self, *schema):
            return Value()

    p, row = HistoryProcessor(), Row("ts", "event_id", "action", "location")
    p.init(Handle())
    got = list(p.handleInputRows((1,), iter([row(2, 2, "visit", "b"), row(None, 4, "back", None), row(2, 1, "visit", "a")]), None))
    got += list(p.handleInputRows((1,), iter([row(3, 5, "forward", None)]), None))
    assert [tuple(r) for r in got] == [(1, 1, "a", 0, 0), (1, 2, "b", 1, 0), (1, 4, "a", 0, 1), (1, 5, "b", 1, 0)]
    assert calls == ["get", "update"] * 2 and kept["x"] == ("b", ["a"], [])


def replayed_places(events):
    h, out = N.History(), []
    for _, _, _, action, location in events:
        h.apply(action, location)
        out.append((h.current, len(h.back), len(h.forward)))
    return out


def test_tooltips(spark):
    edges = spark.createDataFrame([(1, "d", 0, False), (2, "d", 0, True), (3, "d", 1, True), (4, "x", 0, True)], "e int, dst_doc string, dst_topic int, popup boolean")
    topics = spark.createDataFrame([("d", 0, "Title", " body\r\nmore "), ("d", 1, "Blank", "  ")], "doc string, topic_index int, title string, plain_text string")
    assert {r.e: r.tooltip for r in L.destination_tooltips(edges, topics).collect()} == {1: "Title", 2: "body\nmore", 3: "Blank", 4: None}


MACROS = [
    ("jc(`a.hlp','main',0x10)", [("JumpContext", "ALLOW", None)]), ("About(); BACK();", [("About", "ALLOW", None), ("Back", "ALLOW", None)]), ("EF(\"cmd\")", [("ExecFile", "BLOCK", "ExternalExecution")]), ("RR(\"a\",\"b\",\"c\")", [("RegisterRoutine", "BLOCK", "DynamicCode")]),
    ("FE(\"x\")", [("FileExist", "BLOCK", "HostInteraction")]), ("Menu()", [("Menu", "BLOCK", "UnsupportedViewerOperation")]), ("Nope()", [(None, "BLOCK", "UnknownOperation")]), ("Back(1)", [("Back", "BLOCK", "InvalidArguments")]), ("SPC(1,2,256)", [("SetPopupColor", "BLOCK", "InvalidArguments")]),
    ("SPC(1,2,255)", [("SetPopupColor", "ALLOW", None)]), ("", []), ("Back(", [(None, "BLOCK", "Malformed")]), ("AL(`a \"b\" c')", [("ALink", "ALLOW", None)]), ("AL('x", [(None, "BLOCK", "Malformed")]), ("Back(,)", [(None, "BLOCK", "Malformed")]), ("Back()Next()", [(None, "BLOCK", "Malformed")]),
]


def test_macros(spark):
    d = spark.createDataFrame([("d", str(i), t) for i, (t, _) in enumerate(MACROS)], "doc string, origin string, text string")
    got = M.macro_policy(M.macro_calls(d)).orderBy("origin", "call_no").collect()
    for i, (_, want) in enumerate(MACROS):
        assert [(r.canonical, r.verdict, r.reason) for r in got if r.origin == str(i)] == want, i
    args = {r.origin: (r.name, r.arg_types, r.args) for r in got}
    assert args["0"] == ("jc", "SSI", ["a.hlp", "main", "16"]) and args["12"][2] == ['a "b" c']
    long = spark.createDataFrame([("d", "1", "Back();" * 257), ("d", "2", "A(" * 17 + ")" * 17), ("d", "3", "Back(" + "1," * 16 + "1)"), ("d", "4", "A(0xFFFFFFFF,-0x10,2147483648)"), ("d", "5", "A(0xFFFFFFFF, +7)")], "doc string, origin string, text string")
    out = {r.origin: (r.error, r.args) for r in M.macro_calls(long).collect()}
    assert [out[str(i)][0] for i in (1, 2, 3, 4)] == ["too many calls", "nested too deeply", "too many arguments", "number out of range"] and out["5"][1] == ["-1", "7"]


def replayed(events):
    h, out = N.History(depth=3), []
    for _, action, location in events:
        h.apply(action, location)
        out.append((h.current, len(h.back), len(h.forward)))
    return out


def test_history(spark):
    h = N.History()
    for action, location, state in (("visit", "a", ("a", [], [])), ("visit", "b", ("b", ["a"], [])), ("visit", "b", ("b", ["a"], [])), ("back", None, ("a", [], ["b"])), ("forward", None, ("b", ["a"], [])), ("back", None, ("a", [], ["b"])), ("visit", "c", ("c", ["a"], [])), ("forward", None, ("c", ["a"], []))):
        h.apply(action, location)
        assert (h.current, h.back, h.forward) == state
    assert replayed([(0, "visit", str(i)) for i in range(9)])[-1] == ("8", 3, 0)
    rng = random.Random(1)
    rows = [(u, i, i, rng.choice(["visit", "visit", "back", "forward"]), f"t{rng.randrange(5)}") for u in (1, 2) for i in range(300)]
    ev = spark.createDataFrame(rows, "usr long, ts long, event_id long, action string, location string")
    got = {(r.usr, r.event_id): (r.current, r.back_depth, r.forward_depth) for r in N.replay_history(ev.repartition(3)).collect()}
    for u in (1, 2):
        h = N.History()
        for x in rows:
            if x[0] == u:
                h.apply(x[3], x[4])
                assert got[u, x[2]] == (h.current, len(h.back), len(h.forward))
        titles = spark.createDataFrame([("t1", 0, "One"), ("t2", 0, " ")], "doc string, topic_index int, title string")
        listing = [(r.marker, r.location) for r in N.history_listing(ev, titles).where(f"usr = {u}").orderBy("ord").collect()]
        assert listing == [*(("←", x) for x in h.back), ("•", h.current), *(("→", x) for x in reversed(h.forward))]
    opens = spark.createDataFrame([(1, i, i, d) for i, d in enumerate(["one", "two", "three", "four", "five", "Three", "six"])], "usr long, ts long, event_id long, doc string")
    assert [r.doc for r in N.recent_documents(opens).orderBy("rank").collect()] == ["six", "three", "five", "four", "two"]


def test_history_labels(spark):
    places = ["lib/a.hlp#2", "b#0", "b#7", "x#y", "dir\\c.hlp", "lib#1/a.hlp#2"]
    ev = spark.createDataFrame([(1, i, i, "visit", p) for i, p in enumerate(places)], "usr long, ts long, event_id long, action string, location string")
    titles = spark.createDataFrame([("lib/a.hlp", 2, " Two "), ("b", 0, " "), ("dir\\c.hlp", 0, "C")], "doc string, topic_index int, title string")
    assert [r.label for r in N.history_listing(ev, titles).orderBy("ord").collect()] == ["Two — a.hlp", "Topic 1 — b", "Topic 8 — b", "Topic 1 — x#y", "C — c.hlp", "Topic 3 — a.hlp"]


def test_cells(spark):
    """Paths and the order of the walk as a recursion has them, at 64 levels, with siblings, strays and a circle."""
    rng = random.Random(3)
    parent = {i: (None if i < 3 else rng.randrange(max(0, i - 9), i)) for i in range(120)} | {1000 + i: (None if i == 0 else 1000 + i - 1) for i in range(70)}
    cells = {i: rng.randrange(10**9) for i in parent}
    want, children = {}, {}
    for i, p in parent.items():
        children.setdefault(p, []).append(i)
    def walk(i, path, root, seen):
        path = [*path, i]
        if len(path) <= 65:
            want[cells[i]] = (cells[root], len(path) - 1, "/".join(str(cells[x]) for x in path), len(seen))
            seen.append(i)
            for c in sorted(children.get(i, []), key=lambda x: cells[x]):
                walk(c, path, root, seen)
    for r in children[None]:
        walk(r, [], r, [])
    rows = [("d", cells[i], None if p is None else cells[p], "k") for i, p in parent.items()] + [("d", -1, -2, "k"), ("d", -2, -1, "k"), ("d", -3, -4, "k"), ("d", -5, -5, "k"), ("e", 1, None, "k")]
    d = spark.createDataFrame(rows, "doc string, cell_id long, parent_id long, kind string").repartition(5)
    got = {r.cell_id: (r.root, r.depth, r.path, r.nth) for r in T.flatten_nested_cells(d).collect()}
    assert got == want | {1: (1, 0, "1", 0)} and max(v[1] for v in got.values()) == 64


@pytest.mark.parametrize("parts", [1, 4, 9])
def test_site(spark, tmp_path, parts):
    """Lines in order whatever the partitions; every data-action and action names its own action; ids are lines of the actions."""
    rng = random.Random(5)
    docs = spark.createDataFrame([(f"dir/d{i}", "" if i else "T") for i in range(3)], "doc string, title string")
    topics = [(f"dir/d{i}", k, f"title {i} {k}" if k else " ", f"text\n{i} {k}") for i in range(3) for k in range(12)]
    runs = [(d, k, 100 * k + j, "scrolling" if j else "non_scrolling", f"{d} {k} {j}\n<", f"tip {j}" if j == 2 else None) for d, k, *_ in topics for j in range(4)]
    spots = [(d, pos, rng.choice(["open", "noop", "program"]), "dir/d1", 3, "main", None, '[["Back"]]', f"{d} {pos}") for d, _, pos, *_ in runs if pos % 2]
    contents = [("dir/d0", i, 1 + i % 2, f"entry {i}", "dir/d2" if i % 3 else None, i % 12 if i % 3 else None, "main", None) for i in range(20)]
    dest = [(f"k{i % 4}", f"dir/d{i % 3}", i) for i in range(12)]
    frame = lambda rows, ddl: spark.createDataFrame(rng.sample(rows, len(rows)), ddl).repartition(parts)
    t = frame(topics, "doc string, topic_index int, title string, plain_text string")
    near = R.physical_neighbors(t).withColumnsRenamed({"prev": "browse_prev", "next": "browse_next"})
    keys = spark.createDataFrame([(f"k{i}", f"K{i}") for i in range(4)], "key string, keyword string")
    site = str(tmp_path / "site.HTM")
    keep = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        report = X.export_site(site, docs, t, t.limit(2), frame(runs, "doc string, topic_index int, pos long, region string, text string, tooltip string"), frame(spots, "doc string, pos long, kind string, dst_doc string, topic_index int, mode string, win_name string, ops string, message string"), near, frame(contents, "doc string, line long, level int, title string, target_doc string, topic_index int, mode string, win string"), keys, frame(dest, "key string, doc string, topic_index int")).first()
        lines = {}
        for r in X.read_site(spark, site).orderBy("part", "nth").collect():
            lines.setdefault(r.part, []).append(r.value)
            assert r.nth == len(lines[r.part]) - 1
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", keep)
    assert tuple(report)[1:] == (3, 36, 2) and report.path.endswith("/site.html")
    by_place = {(d, pos): (kind, message) for d, pos, kind, *_, message in spots}
    order = sorted(by_place)
    assert len(lines["actions"]) == len(spots) + sum(1 for c in contents if c[5] is not None) + len(topics) + len(dest)
    import re

    seen = []
    for section, (d, k, *_) in zip(lines["topics"], sorted(topics), strict=True):
        assert f'id="hlp-topic-{d}-{k}"' in section
        for action, text in re.findall('data-action="([0-9]+)"[^>]*>([^<]*)</a>', section):
            place = (d, 100 * k + int(text.split("&")[0].split()[2]))
            kind, message = by_place[place]
            seen.append(place)
            assert order[int(action)] == place and f'kind:"{kind}"' in lines["actions"][int(action)] and (kind != "noop" or f'"{message}"' in lines["actions"][int(action)])
    assert sorted(seen) == order
    opens = lambda line, doc, topic: f'doc:"{doc}",topic:{topic},' in lines["actions"][int(re.search(r"action:(\d+)", line)[1])]
    assert all(opens(x, d, k) and f"title {d[5:]} {k}" * bool(k) in x for x, (d, k, *_) in zip(lines["listing"], sorted(topics), strict=True))
    assert all(opens(x, d, k) and f'"K{key[1]}"' in x for x, (key, d, k) in zip(lines["index"], sorted(dest), strict=True))
    assert all("action:null" in x if c[5] is None else opens(x, c[4], c[5]) for x, c in zip(lines["contents"], contents, strict=True))
    assert len(lines["search"]) == len(lines["manifest"]) == 36 and [x.split(",")[0] for x in lines["documents"]] == [f'{{"name":"d{i}"' for i in range(3)]


@pytest.mark.parametrize("compression", ["none", "gzip"])
def test_lines_are_read_where_they_lie(spark, tmp_path, compression):
    """Places come from counts of splits: nothing is written to read lines in order, whichever files and splits they lie in."""
    from helpcorpus.functions.ordering import read_lines, write_lines

    path, rows = str(tmp_path / "lines"), random.Random(9).sample(range(5000), 1200)
    write_lines(spark.createDataFrame([(x, f"line {x}" * (x % 9)) for x in rows], "x int, value string").repartition(7), ["x"], path, rows_per_file=90, compression=compression)
    files = lambda: sum(len(f) for _, _, f in os.walk(spark.conf.get("spark.checkpoint.dir")))
    before, keep = files(), spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
        got = read_lines(spark, path).orderBy("nth").collect()
        digests = {r.nth: r.value for r in read_lines(spark, path, F.length("value")).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", keep)
    assert [tuple(r) for r in got] == [(i, f"line {x}" * (x % 9)) for i, x in enumerate(sorted(rows))]
    assert digests == {r.nth: len(r.value) for r in got} and files() == before


def test_runs_are_shuffled_once(spark):
    """Runs with ids as a join has them, also two links in a place, places in two topics and missing values; sections are put together where texts lie in ranges."""
    runs = spark.createDataFrame([("a", 0, 1, "x"), ("a", 0, 2, "y"), ("a", 1, 1, "z"), ("b", 0, 1, "w"), ("b", 0, 1, "w2"), (None, 0, 1, "n"), ("b", 0, None, "p"), ("c", None, 5, "q")], "doc string, topic_index int, pos long, text string")
    runs = runs.withColumn("region", F.lit("scrolling")).withColumn("tooltip", F.lit(None).cast("string")).repartition(3)
    registry = spark.createDataFrame([(0, "a", "", 1, 10), (0, "a", "", 1, 11), (0, "b", "", 1, 12), (0, "c", "", 5, 13), (1, "a", "", 2, 14), (0, "z", "", 1, 15)], "section int, grp string, sub string, seq long, action_id long")
    rows = lambda d: sorted(map(repr, d.select("doc", "topic_index", "pos", "text", "action_id").collect()))
    got = X.linked_runs(runs, registry)
    assert rows(got) == rows(X.with_actions(runs, registry, "topics", "doc", "pos"))
    plan = X.render_topic_html(got)._jdf.queryExecution().executedPlan().toString()
    assert plan.split("rangepartitioning")[0].count("Exchange") == 1


def test_spellings_without_lists(spark):
    """The spelling of the first document and entry, as the merged index of listed entries has it; places before the first anchor reach nothing."""
    rng = random.Random(11)
    anchors = spark.createDataFrame([(d, 10 + 10 * i, i, 10 + 10 * i) for d in ("a", "b", "c") for i in range(20)], "doc string, topic_offset long, topic_index int, pos long")
    places = [(d, rng.randrange(0, 230), [rng.choice(["Help", "help", "HELP", "tool", "Tool", "solo"]) + rng.choice(["", "s"]) for _ in range(rng.randrange(4))]) for d in ("a", "b", "c") for _ in range(30)] + [("c", -1, ["Never"]), ("c", 5, ["early"]), ("z", 50, ["nowhere"])]
    entries = {}
    for doc, at, words in places:
        for w in words:
            entries.setdefault((doc, w), []).append(at)
    order = {d: sorted(w for e, w in entries if e == d) for d, _ in entries}
    listed = spark.createDataFrame([(d, "K", order[d].index(w), w, at) for (d, w), at in entries.items()], "doc string, table_id string, ord int, keyword string, offsets array<long>")
    want = {(r.key, r.keyword) for r in K.merge_keyword_index(K.keyword_topics(listed, anchors)).collect()}
    got = K.placed_spellings(spark.createDataFrame(places, "doc string, topic_offset long, keywords array<string>").repartition(5), anchors).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want) > 4


def test_shuffles_pass(spark, tmp_path):
    """Files of a shuffle go with the action that needed them, and the session's setting comes back."""
    from helpcorpus.functions.lineage import passing_shuffles

    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    held = lambda: spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().size()
    with passing_shuffles(spark):
        start = held()
        spark.range(3000).repartition(7).write.parquet(str(tmp_path / "a"))
    for _ in range(50):
        if held() > start:
            time.sleep(0.2)
    assert held() <= start and spark.conf.get(key, None) == before


def test_escapes(spark):
    d = spark.createDataFrame([("plain",), ('a"b\\c\n<&>\t\r',), ("\x01 \x1f\x0b\"",), ("",), (None,)], "s string")
    assert [r[0] for r in d.select(js_string(F.col("s"))).collect()] == ['"plain"', '"a\\"b\\\\c\\n\\u003C\\u0026\\u003E\\t\\r"', '"\\u0001 \\u001F\\u000B\\""', '""', None]


def test_output_path():
    assert [X.output_path(p) for p in ("a/b.hlp", "a/b", "a.x/b", "b.HTML", "a/.html", "b.c.d")] == ["a/b.html", "a/b.html", "a.x/b.html", "b.HTML", "a/.html.html", "b.c.html"]


def test_numbers_without_gaps(spark):
    from helpcorpus.functions.ordering import numbered, read_lines, write_lines

    rng = random.Random(8)
    rows = rng.sample(range(10_000), 700)
    d = spark.createDataFrame([(x % 7, x) for x in rows], "a int, b int").repartition(6)
    got = {(r.a, r.b): r.n for r in numbered(d, ["a", "b"], "n", 3).collect()}
    assert got == {k: i + 3 for i, k in enumerate(sorted((x % 7, x) for x in rows))} and numbered(d.limit(0), ["a"], "n").count() == 0
    import tempfile

    path = tempfile.mkdtemp(prefix="lines-")
    write_lines(d.withColumn("value", F.concat_ws(" ", "a", "b")), ["a", "b"], path, rows_per_file=50)
    assert [r.value for r in read_lines(spark, path).orderBy("nth").collect()] == [f"{a} {b}" for a, b in sorted(got)]


def test_values_of_lines_are_made_once(spark, tmp_path):
    """Finding the ranges needs their order only."""
    from helpcorpus.functions.ordering import write_lines

    made = spark.sparkContext.accumulator(0)

    def value(n: int) -> str:
        made.add(1)
        return f"line {n:03}"

    write_lines(spark.range(300), ["id"], str(tmp_path / "lines"), F.udf(value, "string")("id"))
    assert made.value == 300
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "lines")).collect()) == [f"line {n:03}" for n in range(300)]


def test_actions_are_made_once(spark):
    """Finding the ranges of their order reads them again."""
    made = spark.sparkContext.accumulator(0)

    def name(n: int) -> str:
        made.add(1)
        return f"doc{n}"

    topics = spark.range(300).repartition(3).select(F.udf(name, "string")("id").alias("doc"), F.col("id").cast("int").alias("topic_index"))
    none = lambda schema: spark.createDataFrame([], schema)
    spots, contents = none("doc string, pos long, kind string, dst_doc string, topic_index int, mode string, win_name string, ops string, message string"), none("doc string, line long, target_doc string, topic_index int, mode string, win string")
    rows = X.action_registry(X.site_actions(spots, contents, topics, none("key string, doc string, topic_index int"))).orderBy("action_id").collect()
    assert made.value == 300
    assert [(r.grp, r.action_id) for r in rows] == [(d, i) for i, d in enumerate(sorted(f"doc{n}" for n in range(300)))]


def test_actions_need_no_texts(spark, tmp_path):
    """The registry of odd documents is that of their whole tables, and asks for none of them."""
    from helpcorpus.plans import graph as G
    from helpcorpus.plans.registry import QUERIES, Tables

    sf, odd = "/root/testdata/sf0.001", [None, "", "\n", "\n\nlast", "Title words words WORDS Words\n", "İSTANBUL İst ΟΔΟΣ ΟΔΟΣ,\r\nmore\n\n\nlines", "  a  title   with blanks "] + [f"Same title {i % 3}\n" + "x\n" * i for i in range(30)]
    for f in os.listdir(sf):
        if f != "documents.parquet":
            os.symlink(f"{sf}/{f}", tmp_path / f)
    rows = [(3 * i, x, "en", None if i == 5 else f"src{i % 2}", len(x or "")) for i, x in enumerate(odd)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    asked = []

    class Asked(Tables):
        def __call__(self, name):
            asked.append(name)
            return super().__call__(name)

    got = QUERIES["action_registry"](Asked(spark, str(tmp_path))).collect()
    assert "documents" in asked and not {"topics", "records", "keywords"} & set(asked)
    t = Tables(spark, str(tmp_path))
    want = X.action_registry(X.site_actions(t("site_spots"), G.site_contents(t), t("topics"), K.merged_destinations(G.reached(t)))).collect()
    assert {r.section for r in want} == {0, 1, 2, 3} and sorted(map(repr, got)) == sorted(map(repr, want))


def test_places_with_their_keywords(spark):
    """Looked up before keywords become rows, as after it."""
    anchors = spark.createDataFrame([("d", 12, 0, 12), ("d", 76, 1, 76), ("e", 40_000, 0, 12)], "doc string, topic_offset long, topic_index int, pos long")
    places = [("d", 5, ["Early"]), ("d", 12, ["One", "one", "TWO"]), ("d", 20, ["two"]), ("d", 80, ["One", None]), ("d", -1, ["Macro"]), ("d", None, ["None"]), ("e", 100, ["Before"]), ("e", 40_001, ["One"]), ("f", 12, ["Gone"]), ("d", 90, []), ("d", 91, None)]
    got = K.placed_destinations(spark.createDataFrame(places, "doc string, topic_offset long, keywords array<string>"), anchors).collect()
    entries = spark.createDataFrame([(d, "K", i, k, [at]) for i, (d, at, ks) in enumerate(places) for k in ks or []], "doc string, table_id string, ord int, keyword string, offsets array<long>")
    want = K.merged_destinations(K.keyword_topics(entries, anchors)).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, want)) and {tuple(r) for r in got} == {("one", "d", 0), ("two", "d", 0), ("one", "d", 1), (None, "d", 1), ("one", "e", 0)}


def test_block_layout(spark):
    from helpcorpus.operators import profile as P

    rows = [(15, 4, "Windows30", "none", 2048, 2036), (16, 8, "Unknown 16", "none", 2048, 2036), (21, 0, "Windows31", "none", 4096, 4084), (27, 4, "Multimedia", "lz77", 4096, 16384), (33, 8, "Windows95", "lz77", 2048, 16384), (99, 12, "Unknown 99", "unknown 12", 4096, 4084)]
    d = spark.createDataFrame([(str(i), *r[:2]) for i, r in enumerate(rows)], "doc string, minor int, flags int")
    assert [tuple(r)[1:] for r in P.block_layout(d).orderBy("doc").collect()] == rows


def test_bookmarks(spark, tmp_path):
    rows = spark.createDataFrame([(1, "One\t\\n", "a\\b.hlp", 3, None, "main"), (2, "Again", "a\\b.hlp", 3, None, "main"), (3, "Two", "c", 0, -5, None), (4, None, "c", 1, None, None)], "ord long, label string, path string, topic long, at_offset long, win string")
    marks = N.bookmarks(rows)
    assert sorted(r.label for r in marks.collect()) == ["One\t\\n", "Two"]
    N.write_bookmarks(marks, str(tmp_path / "b"))
    back = N.read_bookmarks(spark, str(tmp_path / "b"))
    assert sorted(back.collect(), key=repr) == sorted(marks.select(*back.columns).collect(), key=repr)
    bad = spark.createDataFrame([("One\tp\t1\t\t",), ("bad\\x\tp\t1\t\t",), ("four\tp\t1\t",), ("n\tp\tx\t\t",)], "value string")
    assert [r.label for r in N.parse_bookmark_lines(bad).collect()] == ["One"]


@pytest.mark.parametrize("spec,want", [("3-8", [2, 3, 4, 5, 6, 7]), ("1-3, 7; 10-12", [0, 1, 2, 6, 9, 10, 11]), ("2;2;1-4", [0, 1, 2, 3]), ("8-3", "backwards"), ("0", "out of range"), ("13", "out of range"), ("x", "not a number"), ("", "nothing selected"), ("1-2-3", "malformed range"), ("x,8-3", "not a number")])
def test_ranges(spark, spec, want):
    good, bad = X.parse_topic_ranges(spark.createDataFrame([("d", spec, 12)], "doc string, spec string, n int"))
    assert (sorted(r.topic_index for r in good.collect()) or bad.first().error) == want


def test_streams_equal_batches(spark):
    from helpcorpus import plans

    q = plans.queries()
    for batch, stream in (("replay_history", "stream_history"), ("recent_documents", "stream_recent_documents")):
        a, b = (q[k](spark, "/root/testdata/sf0.001") for k in (batch, stream))
        assert sorted(map(tuple, a.collect()), key=repr) == sorted(map(tuple, b.select(*a.columns).collect()), key=repr)


def test_plans_push_down(spark):
    """The searches read three columns, and top-k queries do not sort everything."""
    from helpcorpus import plans

    plan = plans.queries()["search_corpus"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "n_chars" not in plan
    plan = plans.queries()["search_batch"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "NestedLoop" not in plan and "Cartesian" not in plan


def test_without_llm():
    """The rest imports and has its queries where the subpackage is missing."""
    import subprocess
    import sys

    code = "import sys; sys.modules['helpcorpus.llm'] = None; import __spark_entry__ as e; assert len(e.queries()) >= 100 and not any(k.startswith('op1') for k in e.queries()) and 'pipeline' not in e.queries() and e.oracle_sql()"
    import os

    subprocess.run([sys.executable, "-c", code], check=True, cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
