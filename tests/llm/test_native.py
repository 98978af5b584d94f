"""Sharding, exact dedup, mixing and decontamination against brute force."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import pytest
from llm_tables import table, words

from helpcorpus.llm import exactdedup
from helpcorpus.llm.common import ranked
from helpcorpus.llm.decontaminate import contamination, decontaminated, leaks
from helpcorpus.llm.exactdedup import exact_dedup
from helpcorpus.llm.jaccard import jaccard_components, one_of_each
from helpcorpus.llm.mixing import exponent, mix, mixed_rows
from helpcorpus.llm.sharding import shuffle_shards, write_shards


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_dedup(docs, rows, none, monkeypatch):
    for size in (4096, 8):  # many levels of names, too
        monkeypatch.setattr(exactdedup, "BLOCK_BYTES", size)
        got = exact_dedup(docs)
        assert not re.search("Python|Pandas|Arrow", plan(got))
        flat = lambda t: re.sub("[\x20\x09-\x0d]", "", t or "")
        groups = defaultdict(list)
        for i, t, _ in rows:
            groups[flat(t)].append((-len(t or ""), i is None, i or 0, i))
        want = Counter()
        for i, t, _ in rows:
            g = groups[flat(t)]
            want[(i, min(g)[3], len(g), hashlib.sha256(flat(t).encode()).hexdigest())] += 1
        out = got.collect()
        assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in out) == want
        kept = [r for r in out if r.kept]
        assert len(kept) == len({r.text_sha256 for r in out}) == len({r.identity for r in out})
        assert all(r.doc_id == r.keep_id for r in kept)
        assert exact_dedup(none).count() == 0


def test_dedup_blocks_share_content(spark):
    # same blocks in another order, and one text the beginning of another
    a, b = "a" * 4096, "b" * 4096
    d = table(spark, [(1, a + b, "s"), (2, b + a, "s"), (3, a + b + "c", "s"), (4, a + b, "s"), (5, a, "s")])
    assert {r.doc_id: r.keep_id for r in exact_dedup(d).collect()} == {1: 1, 2: 2, 3: 3, 4: 1, 5: 5}


def test_shards(docs, rows, none, spark, tmp_path):
    got = shuffle_shards(docs, 7)
    assert not re.search("Python|Pandas|Arrow", plan(got))
    out = got.collect()
    assert Counter((r.doc_id, r.text) for r in out) == Counter((i, t) for i, t, _ in rows)
    slots = defaultdict(list)
    for r in out:
        assert r._size == len((r.text or "").encode()) + 1 and r._crc32 == zlib.crc32((r.text or "").encode()) and r._law == "rows"
        slots[r._shard].append(r._slot)
    assert set(slots) == set(range(7)) and all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    again = {(r._shard, r._slot): r.text for r in shuffle_shards(docs, 7).collect()}
    assert again == {(r._shard, r._slot): r.text for r in out}
    assert shuffle_shards(none).count() == 0
    assert shuffle_shards(docs.limit(3), 16).count() == 3
    write_shards(got, str(tmp_path / "x"), rows_per_file=4)
    back = spark.read.parquet(str(tmp_path / "x"))
    assert Counter((r.text, r._shard, r._slot, r._run) for r in back.collect()) == Counter((r.text, r._shard, r._slot, r._slot // 4) for r in out)


def dealt(df, **more):
    return Counter((r.doc_id, r.text, r._shard, r._slot) for r in shuffle_shards(df, 5, **more).collect())


def test_shards_depend_on_rows_alone(spark, rows):
    many = [*rows, *[(67, "same row", "s3")] * 150, *[(500 + i, f"text {i % 70}", "s") for i in range(300)]]
    want, keep = None, {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    try:
        for parts, adaptive, order in ((4, "true", 1), (9, "false", -1), (64, "true", 1)):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            spark.conf.set("spark.sql.adaptive.enabled", adaptive)
            got = dealt(table(spark, many[::order]).repartition(parts), bucket_bytes=20_000)
            want = want or got
            assert got == want and len(got) == len(many)  # every row has a place of its own
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)
    assert dealt(table(spark, many), bucket_bytes=20_000, seed=8) != want


def test_shards_part_copies(spark):
    """Rows of one id, copies too, are spread over buckets, so none is overfull."""
    d = table(spark, [(1, "t", "s")] * 1000 + [(1, f"u{i}", "s") for i in range(1000)])
    out = shuffle_shards(d, 10, bucket_bytes=13_000).collect()
    per = Counter(r._shard for r in out if r.text == "t")
    assert len({(r._shard, r._slot) for r in out}) == len(out) == 2000 and len(per) == 10 and max(per.values()) < 150


def test_names_that_clash(spark):
    own = ["_size", "_crc32", "_law", "_shard", "_slot", "size", "shard", "slot", "_tokens", "_weight", "_epoch", "_block", "_rank", "_gone", "_key", "_leak", "k1", "k2", "occ", "rid", "key"]
    d = spark.createDataFrame([(i, f"a b c {i % 3}", "s", *range(len(own))) for i in range(9)], ["doc_id", "text", "source", *own])
    out = shuffle_shards(d, 4)
    assert sorted(out.columns) == sorted(d.columns) and sorted(r._size for r in out.collect()) == [8] * 9
    mixed = mix(d)
    assert sorted(mixed.columns) == sorted(d.columns) and {r._tokens for r in mixed.collect()} == {4}
    bench = spark.createDataFrame([(1, "a b c 1")], "item_id long, text string")
    for kept, n in ((mixed_rows(d), 9), (decontaminated(d, bench), 6), (one_of_each(d), 3)):
        assert kept.columns == d.columns and [r._size for r in kept.collect()] == [0] * n
    assert exact_dedup(d).count() == jaccard_components(d).count() == contamination(d, bench).count() == 9


def test_ranks(spark):
    import random

    rng = random.Random(2)
    pairs = [(rng.randrange(50), rng.randrange(50)) for _ in range(400)]
    for parts in (1, 7):
        d = spark.createDataFrame(pairs, "a long, b long").distinct().repartition(parts)
        got = ranked(d, ["a", "b"], 5).collect()
        assert {(r.a, r.b): r.name for r in got} == {p: i + 5 for i, p in enumerate(sorted(set(pairs)))}
    assert ranked(d.limit(0), ["a", "b"]).count() == 0


def test_mixing(docs, rows, none):
    got = mix(docs, max_repeats=2.0, block_tokens=500)
    assert not re.search("Python|Pandas|Arrow", plan(got))
    out = got.collect()
    source = {s for _, _, s in rows}
    times = Counter((r.doc_id, r.text, r.source) for r in out)
    assert set(times) == {(i, t, s) for i, t, s in rows}  # nothing is lost with the least covering budget
    tokens = Counter()
    for _, t, s in rows:
        tokens[s] += len((t or "").split())
    mixed = Counter()
    for r in out:
        mixed[r.source] += r._tokens
    weight = {r.source: r._weight for r in out}
    assert abs(sum(weight.values()) - 1) < 1e-9
    for s in source:
        assert tokens[s] <= mixed[s] <= 2 * tokens[s] + 1e-6
    # realised shares are within a document of the weights
    budget = max(tokens[s] / weight[s] for s in source if weight[s])
    longest = max(len((t or "").split()) for _, t, _ in rows)
    assert all(abs(mixed[s] - weight[s] * budget) <= longest + 1 for s in source)
    assert mix(none).count() == 0


@pytest.mark.parametrize("target", [{"max_repeats": 1.3}, {"entropy": 0.97}, {"max_repeats": 4.0, "budget": 30_000}])
def test_mixing_against_its_definition(docs, rows, target):
    """Weights by a bisection of their own, whole epochs of each row, and rows of the cut epoch up to the budget."""
    tokens, rows_of = Counter(), Counter()
    for _, t, s in rows:
        tokens[s] += len(re.findall(r"[^\x20\x09-\x0d]+", t or ""))
        rows_of[s] += 1
    top = max(tokens.values())

    def weights(alpha):
        w = {s: (n / top) ** alpha for s, n in tokens.items() if n}
        return {s: x / sum(w.values()) for s, x in w.items()}

    def meets(alpha):
        w = weights(alpha)
        if "max_repeats" in target:
            rate = [w[s] / tokens[s] for s in w]
            return max(rate) / min(rate) <= target["max_repeats"]
        return -sum(x * math.log(x) for x in w.values()) < target["entropy"] * math.log(len(w))

    low, high = 0.0, 1.0
    if meets(low):
        high = low
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (low, middle) if meets(middle) else (middle, high)
    want = weights(high)
    budget = target.get("budget") or max(tokens[s] / want[s] for s in want)
    got = mix(docs, max_repeats=target.get("max_repeats"), entropy=target.get("entropy"), budget=target.get("budget"), block_tokens=100).collect()
    weight = {r.source: r._weight for r in got}
    assert all(abs(weight[s] - want[s]) < 1e-5 for s in weight)
    mixed, times = Counter(), Counter()
    for r in got:
        mixed[r.source] += r._tokens
        times[r.doc_id, r.text, r.source] += 1
    for s in want:
        epochs = want[s] * budget / tokens[s]
        full = math.floor(epochs + 1e-4)  # the exponents differ by some 1e-7
        longest = max(len((t or "").split()) for _, t, x in rows if x == s)
        assert mixed[s] <= want[s] * budget + 2 and mixed[s] > want[s] * budget - longest - 2
        for key, n in Counter((i, t, x) for i, t, x in rows if x == s).items():
            assert n * full <= times[key] <= n * (full + 1)


def test_mixing_targets(spark, docs):
    t = spark.createDataFrame([("a", 1000), ("b", 100), ("c", 10)], "s string, tokens long")
    assert abs(exponent(t, max_repeats=10.0) - 0.5) < 1e-5  # (1000 / 10) ** (1 - alpha) = 10
    assert exponent(t, max_repeats=1000.0) == 0 and exponent(t, entropy=1.0) < 1e-6 and exponent(t, entropy=0.0) == 1
    small = mix(docs, budget=500).collect()
    assert 0 < sum(r._tokens for r in small) <= 500


def test_mixing_cuts_blocks_in_order(spark):
    """The epoch that the budget cuts: whole blocks in permuted order, then a prefix of one block; tokenless rows go with their block."""
    rows = [(i, "w " * (i % 7), "s") for i in range(400)]
    d = table(spark, rows)
    every = mix(d, budget=10**6, block_tokens=50).collect()
    rank = {(r._block, r._rank.row_key): r for r in every if r._epoch == 0}
    assert len(rank) == 400
    for budget in (1, 37, 300, 700):
        got = mix(d, budget=budget, block_tokens=50).collect()
        assert {r._epoch for r in got} <= {0} and len({r.doc_id for r in got}) == len(got)
        took, by = sum(r._tokens for r in got), defaultdict(set)
        for r in got:
            by[r._block].add(r.doc_id)
        whole = defaultdict(set)
        for r in rank.values():
            whole[r._block].add(r.doc_id)
        cut = [b for b in by if by[b] != whole[b]]
        assert took <= budget and len(cut) <= 1
        if cut:  # within the cut block a prefix by rank; what comes next would pass the budget
            inside = sorted((r for (b, _), r in rank.items() if b == cut[0]), key=lambda r: r._rank.row_key)
            n = len(by[cut[0]])
            assert {r.doc_id for r in inside[:n]} == by[cut[0]] and took + inside[n]._tokens > budget
    again = mix(d.repartition(13), budget=300, block_tokens=50).collect()
    assert {(r.doc_id, r._rank) for r in again} == {(r.doc_id, r._rank) for r in mix(d, budget=300, block_tokens=50).collect()}


def test_contamination(spark, none):
    import random

    rng = random.Random(3)
    item = words(rng, 40, 10**6)
    near = item.split()
    near[20] = "other"  # five of 36 shingles differ: 31 / 41 = 0.76
    edge = item.split()
    edge[1] = "other"  # two differ: 34 / 38 = 0.89
    bench = [(1, item), (2, "x y"), (3, None), (4, ""), (5, words(rng, 25, 10**6)), (5, "a second text of one id comes here and is long enough")]
    pad = lambda t: f"{words(rng, 300)}. {t}! {words(rng, 50)}"
    d = [(1, item, "s"), (2, pad(item.upper()), "s"), (3, pad(" ".join(near)), "s"), (4, pad(" ".join(edge)), "s"), (5, words(rng, 500), "s"), (6, None, "s"), (7, "", "s"), (8, "X, y", "s"), (9, pad("x y"), "s"), (10, " ".join(item.split()[:36]), "s"), (11, " ".join(item.split()[:20]), "s"), (None, pad(bench[4][1]), "s"), (12, "of " * 3000, "s"), (13, pad(bench[5][1]), "s"), (13, pad(bench[5][1]), "s")]
    docs, b = table(spark, d), spark.createDataFrame(bench, "item_id long, text string")
    got = contamination(docs, b)
    assert not re.search("Python|Pandas|Arrow", plan(got))
    want = {1: [1], 2: [1], 3: [], 4: [1], 5: [], 6: [], 7: [], 8: [2], 9: [2], 10: [1], 11: [], None: [5], 12: [], 13: [5]}
    out = got.collect()
    assert len(out) == len(d) and all(r["items"] == want[r.doc_id] and r.contaminated == bool(want[r.doc_id]) for r in out)
    assert {r.doc_id: round(r.similarity, 3) for r in out}[4] == round(34 / 38, 3)
    left = decontaminated(docs, b)
    assert sorted(r.doc_id for r in left.collect()) == [3, 5, 6, 7, 11, 12] and left.columns == docs.columns
    assert contamination(none, b).count() == 0 and contamination(docs, b.limit(0)).where("contaminated").count() == 0


def most_similar(text, item, k=5):
    """The greatest weighted Jaccard similarity over all starts, as (overlap, union)."""
    split = lambda t: re.sub("[^0-9a-z]+", " ", t.lower()).split()
    d, w = split(text), split(item)
    m = min(k, len(w))
    grams = lambda x: Counter(tuple(x[i : i + m]) for i in range(len(x) - m + 1))
    want, best = grams(w), (0, 1)
    for s in range(max(1, len(d) - len(w) + 1)):
        window = grams(d[s : s + len(w)])
        both = sum((window & want).values())
        best = max(best, (both, sum((window | want).values())), key=lambda x: x[0] / x[1])
    return best


def test_contamination_of_reordered_passages(spark):
    import random

    rng = random.Random(8)
    bench = [(i, words(rng, n, 10**6)) for i, n in enumerate((60, 60, 45, 100, 9, 4))]
    d = []
    for _, item in bench[:4]:
        w = item.split()
        for cuts in ([0.5], [0.5], [0.3], [0.3, 0.7], [0.1, 0.6], [0.9], [0.05, 0.95]):
            at = [0, *[int(len(w) * c) for c in cuts], len(w)]
            parts = [w[a:b] for a, b in zip(at, at[1:], strict=False)][::-1]
            d.append((len(d), " ".join([words(rng, rng.choice([0, 3, 50]), 10**6), *sum(parts, []), words(rng, rng.choice([0, 50]), 10**6)]), "s"))
            gap = words(rng, rng.choice([1, 2, 6]), 10**6)
            d.append((len(d), " ".join([words(rng, 50, 10**6), *parts[0], gap, *sum(parts[1:], []), *parts[0]]), "s"))
    d += [(100 + i, " ".join(item.split()[: len(item.split()) * 9 // 10]), "s") for i, item in bench]
    out = contamination(table(spark, d), spark.createDataFrame(bench, "item_id long, text string")).collect()
    best = {i: {j: most_similar(t, item) for j, item in bench} for i, t, _ in d}
    want = {i: sorted(j for j, (a, b) in best[i].items() if 100 * a >= 80 * b) for i in best}
    assert {r.doc_id: r["items"] for r in out} == want
    assert all(abs(r.similarity - max([best[r.doc_id][j][0] / best[r.doc_id][j][1] for j in want[r.doc_id]], default=0)) < 1e-9 for r in out)
    assert want[0] == [0] and any(want.values()) and not all(want.values())


def test_contamination_with_repeated_shingles(spark):
    import random

    rng = random.Random(9)
    bench, d = [], []
    for i in range(4):  # what differs is one repeated word, whose 28 equal shingles move the fingerprint
        a, b = words(rng, 150, 10**6), words(rng, 160, 10**6)
        filled = [" ".join(["na"] * 32), words(rng, 32, 10**6), " ".join(["no"] * 32)]
        bench.append((i, f"{a} {filled[i % 2]} {b}"))
        d += [(10 * i + j, f"{words(rng, 40, 10**6)} {a} {fill} {b} {words(rng, 9, 10**6)}", "s") for j, fill in enumerate(filled)]
    out = contamination(table(spark, d), spark.createDataFrame(bench, "item_id long, text string")).collect()
    best = {i: {j: most_similar(t, item) for j, item in bench} for i, t, _ in d}
    want = {i: sorted(j for j, (a, b) in best[i].items() if 100 * a >= 80 * b) for i in best}
    assert {r.doc_id: r["items"] for r in out} == want and all(want.values())


def test_recall_of_the_index(spark):
    """Passages that differ from an item as much as 0.8 allows, by single words: at least 0.98 of those that brute force finds come through the index."""
    import random

    rng = random.Random(10)
    bench = [(i, words(rng, n, 10**6)) for i, n in enumerate([60, 80, 110, 150, 220] * 4)]
    d = []
    for i, item in bench:
        for j in range(25):
            w = item.split()
            shingles = len(w) - 4
            most = shingles / 9 / 5  # words whose five shingles may differ each
            for _ in range(round(most)):
                w[rng.randrange(4, len(w) - 4)] = f"x{rng.randrange(10**9)}"
            d.append((100 * i + j, f"{words(rng, 30, 10**6)} {' '.join(w)} {words(rng, 30, 10**6)}", "s"))
    out = {r.doc_id: r["items"] for r in contamination(table(spark, d), spark.createDataFrame(bench, "item_id long, text string")).collect()}
    found = total = 0
    for i, t, _ in d:
        a, b = most_similar(t, bench[i // 100][1])
        if 100 * a >= 80 * b:
            total += 1
            found += out[i] == [i // 100]
        else:
            assert out[i] == []
    assert total > 300 and found >= 0.98 * total, (found, total)


def sliding(d, w, m):
    """As most_similar, for shingle lists of a document and an item, counting as the window moves."""
    want, n, size = Counter(w), min(len(w), len(d)), len(w)
    seen, both, best = Counter(), 0, 0.0
    for i, g in enumerate(d):
        seen[g] += 1
        both += seen[g] <= want[g]
        if i >= size:
            out = d[i - size]
            both -= seen[out] <= want[out]
            seen[out] -= 1
        if i >= n - 1:
            best = max(best, both / (n + size - both))
    return best


def test_contamination_of_long_items(spark):
    """Items of 20,000 words, whole, changed, twice in a text and with shingles that repeat; few windows are laid for them."""
    import random

    rng = random.Random(12)
    plain = words(rng, 20_000, 10**6)
    refrain = " ".join(f"{words(rng, 45, 10**6)} and so the chorus sings it once again" for _ in range(380))
    bench = [(1, plain), (2, refrain), (3, words(rng, 60, 10**6))]

    def changed(text, n):
        w = text.split()
        for at in rng.sample(range(len(w)), n):
            w[at] = f"x{rng.randrange(10**9)}"
        return " ".join(w)

    pad = lambda n: words(rng, n, 10**6)
    d = [(1, plain), (2, f"{pad(30_000)} {changed(plain, 300)} {pad(5000)}"), (3, f"{plain} {pad(10)} {changed(plain, 100)}"), (4, changed(plain, 900))]
    d += [(5, f"{pad(70)} {refrain} {pad(9)}"), (6, f"{refrain} {refrain}"), (7, " ".join(plain.split()[:9000])), (8, f"{bench[2][1]} {plain} {bench[2][1]}"), (9, pad(40_000))]
    docs, items = table(spark, [(i, t, "s") for i, t in d]), spark.createDataFrame(bench, "item_id long, text string")
    split = lambda t: [tuple(w[i : i + 5]) for w in [t.lower().split()] for i in range(len(w) - 4)]
    grams = {i: split(t) for i, t in bench}
    best = {i: {j: sliding(split(t), g, 5) for j, g in grams.items()} for i, t in d}
    want = {i: sorted(j for j, x in best[i].items() if x >= 0.8) for i in best}
    out = {r.doc_id: r for r in contamination(docs, items).collect()}
    assert {i: r["items"] for i, r in out.items()} == want
    assert [want[i] for i in range(1, 10)] == [[1], [1], [1], [], [2], [2], [], [1, 3], []]
    assert all(abs(r.similarity - max([best[i][j] for j in want[i]], default=0)) < 1e-9 for i, r in out.items())
    laid = leaks(docs, items).groupBy("k1", "k2", "item_id").count().collect()
    assert max(r["count"] for r in laid) <= 4  # windows of a text for one item


def test_contamination_of_the_given_tables(spark):
    """Recall and precision against every window of every document, for all items that share a shingle with it."""
    from helpcorpus.llm.common import read

    docs, bench = (read(spark, "/root/testdata/sf0.01", t) for t in ("documents", "benchmark"))
    split = lambda t: [w for w in re.sub(r"[\W_]+", " ", (t or "").lower()).split(" ") if w]
    items, at = {}, defaultdict(set)
    for r in bench.collect():
        w = split(r.text)
        m = min(5, len(w))
        items[r.item_id] = m, [tuple(w[i : i + m]) for i in range(len(w) - m + 1)]
        for g in items[r.item_id][1]:
            at[g].add(r.item_id)
    want = {}
    for r in docs.collect():
        w, found = split(r.text), []
        for m in {m for m, _ in items.values()}:
            d = [tuple(w[i : i + m]) for i in range(len(w) - m + 1)]
            found += [i for i in set().union(*[at[g] for g in set(d) if g in at]) if items[i][0] == m and sliding(d, items[i][1], m) >= 0.8 - 1e-12]
        want[r.doc_id] = sorted(found)
    assert {r.doc_id: r["items"] for r in contamination(docs, bench).collect()} == want and sum(map(bool, want.values())) > 5
