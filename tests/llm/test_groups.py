"""Sharding, mixing, near duplicates, lines, vectors and top-k."""

import itertools
import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from counterpoise.llm import binpack, bitslices, fuzzy_lines, lattice_hash, linking, minhash, queries, raking


def connected(nodes, links):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    return {n: root(n) for n in nodes}


def test_components_equal_a_union_find(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(70)]
    got = {r.node: r.component for r in linking.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = {x for e in edges if e[0] != e[1] for x in e}
    assert got == connected(nodes, [e for e in edges if e[0] != e[1]])
    assert linking.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_balanced_tree_is_a_sorted_set():
    rng, tree, held = random.Random(1), binpack.BalancedTree(), set()
    for _ in range(3000):
        key = (rng.randrange(60), rng.randrange(40))
        if key in held:
            tree.remove(key)
            held.discard(key)
        else:
            tree.insert(key)
            held.add(key)
        probe = (rng.randrange(60), -1)
        assert tree.at_least(probe) == min((k for k in held if k >= probe), default=None)
    assert tree._root.height <= 2 * np.log2(len(held) + 2)


def test_best_fit_decreasing_equals_a_plain_scan():
    rng = random.Random(2)
    for _ in range(30):
        sizes = sorted((rng.randrange(1, 60) for _ in range(80)), reverse=True)
        left, want = [], []
        for size in sizes:
            fits = [(r, i) for i, r in enumerate(left) if r >= size]
            if fits:
                i = min(fits)[1]
            else:
                i = len(left)
                left.append(100)
            left[i] -= size
            want.append(i)
        assert binpack.best_fit(sizes, 100) == want
        packed = binpack.pack(sizes, 7)
        loads = [sum(s for s, p in zip(sizes, packed) if p == k) for k in range(7)]
        assert max(loads) - min(loads) <= max(sizes)


@pytest.mark.parametrize("capacity", [None, 4000])
def test_shards(frame, odd, capacity):
    texts = odd + [f"text {i % 37} " * (i % 37 + 1) for i in range(300)]
    rows = binpack.assign_shards(frame(texts), 6, capacity=capacity, rows_per_task=10).collect()
    assert len(rows) == len(texts)
    by_text, slots, loads = {}, {}, {}
    for r in rows:
        text = texts[r.doc_id] or ""
        assert r.size == len(text.encode()) + 8
        assert by_text.setdefault(text, r.shard) == r.shard
        slots.setdefault(r.shard, []).append(r.slot)
        loads[r.shard] = loads.get(r.shard, 0) + r.size
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    if capacity is None:
        assert set(slots) <= set(range(6))
        even = binpack.assign_shards(frame([f"t{i} " * 20 for i in range(600)]), 6).groupBy("shard").agg(F.sum("size").alias("s")).collect()
        assert max(r.s for r in even) - min(r.s for r in even) < 200
    else:
        groups = {}
        for r in rows:
            groups[texts[r.doc_id] or ""] = groups.get(texts[r.doc_id] or "", 0) + r.size
        alone = {by_text[t] for t, size in groups.items() if size > capacity}
        assert all(load <= capacity for shard, load in loads.items() if shard not in alone)
    assert binpack.assign_shards(frame([]), 6).count() == 0


def test_raking_meets_the_margins(spark):
    rng = np.random.default_rng(4)
    cells = [(f"s{a}", f"l{b}", float(rng.integers(100, 5000))) for a in range(5) for b in range(3)]
    df = spark.createDataFrame(cells, "source string, lang string, tokens double")
    total = sum(c[2] for c in cells)
    targets = {"source": 0.5, "lang": {"l0": 0.5, "l1": 0.3, "l2": 0.2}}
    rows = raking.rake(df, targets, rate=0.3, sweeps=30).collect()
    lang = {v: sum(r.weight for r in rows if r.lang == v) / total / 0.3 for v in ("l0", "l1", "l2")}
    assert lang == pytest.approx({"l0": 0.5, "l1": 0.3, "l2": 0.2}, abs=1e-3)
    raw = {s: sum(c[2] for c in cells if c[0] == s) ** 0.5 for s in {c[0] for c in cells}}
    source = {s: sum(r.weight for r in rows if r.source == s) / total / 0.3 for s in raw}
    assert source == pytest.approx({s: v / sum(raw.values()) for s, v in raw.items()}, abs=1e-3)


def test_mix_edges(frame, odd):
    docs = frame(odd)
    dims = {"source": F.col("source"), "lang": F.col("lang"), "topic": raking.topic_of("text")}
    out = raking.mix(docs, {"source": 0.7, "lang": 0.8, "topic": {"prose": 0.9}}, dims)
    rows = out.collect()
    assert len(rows) == len(odd) and all(0 <= r.mix_chance <= 1 and r.mix_kept is not None for r in rows)
    assert set(docs.columns) <= set(out.columns)
    assert raking.mix(frame([]), {"source": 0.7}, {"source": F.col("source")}).count() == 0


def test_mix_finds_notices_anywhere(frame):
    """The pipeline's topics come from the whole text."""
    late = "plain words " * 40 + "\nCopyright by the authors"
    topics = frame([late, late.replace("Copyright", "Written")]).select("doc_id", queries.mix_dimensions()["topic"].alias("t")).collect()
    assert {r.doc_id: r.t for r in topics} == {0: "notice", 1: "prose"}


def shingles(text, width=5):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} if len(words) >= width else ({tuple(words)} if words else set())


def near_by_force(texts):
    sets = {i: shingles(t) for i, t in texts.items()}
    links = [
        (a, b) for a, b in itertools.combinations(sets, 2)
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])
    ]
    component = connected(sets, links)
    return {i: (len(s), component[i]) for i, s in sets.items()}


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


def test_near_duplicates_equal_brute_force(frame, odd):
    rng = random.Random(7)
    texts = list(odd)
    for _ in range(6):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(30, 160))]
        texts += [edited(rng, words, rng.randrange(0, 5)) for _ in range(12)] + [" ".join(words)] * 2
    want = near_by_force(dict(enumerate(texts)))
    for tiles in ({}, {"tile_rows": 4, "tile_shingles": 300}):
        rows = minhash.near_duplicates(frame(texts), **tiles).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == want
        assert all(r.kept == (r.doc_id == r.component_id) for r in rows)
    assert minhash.near_duplicates(frame([])).count() == 0
    assert minhash.near_duplicates(frame([(1, "a b c"), (1, "a b c"), (2, "A B C")])).where("component_id = 1").count() == 3


def test_sketch_fills_and_estimates():
    rng = np.random.default_rng(0)
    for n, m in ((3, 2), (300, 60), (3000, 500)):
        pool = rng.integers(0, 1 << 63, size=n + m, dtype=np.uint64)
        a, b = np.unique(pool[:n]), np.unique(pool[m:])
        s = minhash.sketch(np.concatenate([a, b, a[:0]]), np.array([0, len(a), len(a) + len(b), len(a) + len(b)]), 400)
        assert (s[:2] != minhash._EMPTY).all() and (s[2] == minhash._EMPTY).all()
        jaccard = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert (s[0] == s[1]).mean() == pytest.approx(jaccard, abs=0.12)


def test_fuzzy_lines(frame, odd):
    rng = random.Random(3)
    base = [" ".join(f"word{rng.randrange(3000)}" for _ in range(60)) for _ in range(12)]
    texts = ["\n".join([line, "Same line here!", "", str(i)]) for i, line in enumerate(base)]
    texts += ["\n".join([line.upper() + ".", "same LINE here", edited(rng, line.split(), 1)]) for line in base] + odd
    groups = {(r.k, r.pos): (tuple(r.first), tuple(r.exact)) for r in fuzzy_lines.line_groups(frame(texts)).collect()}

    import re
    lines = {(i, p): re.sub(r"[^\w]+|_", " ", line.lower()).strip() for i, t in enumerate(texts) for p, line in enumerate((t or "").split("\n"))}
    lines = {at: body for at, body in lines.items() if body}
    assert set(groups) == set(lines)
    first = {}
    for at in sorted(lines):
        first.setdefault(lines[at], at)
    assert all(groups[at][1] == first[body] for at, body in lines.items())
    # Every fuzzy group holds lines that are alike; most of the lines with one changed word are found.
    joined = [at for at in lines if groups[at][0] != groups[at][1]]
    assert all(groups[at][0][0] + 12 == at[0] or groups[at][0][0] == at[0] for at in joined)
    out = fuzzy_lines.dedup_lines(frame(texts))
    assert out.columns == frame(texts).columns
    kept = {r.doc_id: r.text for r in out.collect()}
    assert kept[0] == texts[0] and kept[1] == f"{base[1]}\n\n1"
    assert fuzzy_lines.dedup_lines(frame([])).count() == 0


def test_fuzzy_line_groups_equal_brute_force(frame):
    """All pairs by edit similarity alone, without any filter of the method's own."""
    rng = random.Random(9)
    lines = []
    for n_words in (12, 30, 90):
        for _ in range(5):
            words = [f"w{rng.randrange(999)}" for _ in range(n_words)]
            lines += [edited(rng, words, n) for n in (0, 1, 1, 2)]

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    links = [
        (a, b) for a, b in itertools.combinations(range(len(lines)), 2)
        if abs(len(lines[a]) - len(lines[b])) <= 0.1 * max(len(lines[a]), len(lines[b])) and distance(lines[a], lines[b]) <= 0.1 * max(len(lines[a]), len(lines[b]))
    ]
    want = connected(range(len(lines)), links)
    assert len(links) > 40 and {r.k: r.first.k for r in fuzzy_lines.line_groups(frame(lines)).collect()} == want


def test_short_lines_match_fuzzily(frame):
    lines = [
        "all rights reserved 2019", "all rights reserved 2018", "page 17 of 64", "page 27 of 64", "one two", "one twx",
        "please read the terms of use of this site before you order any of the goods shown on these pages or in the shop today",
        "please read the terms of use of this site before you order any of the wares shown on these pages or in the shop today",
        "条款与条件适用于本网站的所有用户和访客", "条款与条件适用于本网站的所有用户和来客", "y" * 60 + "x" * 4000, "y" * 60 + "z" * 300 + "x" * 3700,
    ]
    first = {r.k: r.first.k for r in fuzzy_lines.line_groups(frame(lines)).collect()}
    assert first == {0: 0, 1: 0, 2: 2, 3: 2, 4: 4, 5: 5, 6: 6, 7: 6, 8: 8, 9: 8, 10: 10, 11: 10}


def test_fuzzy_line_recall_at_the_threshold(frame):
    """Pairs by edit similarity alone: as many letters are changed as a similarity of 0.9 (or 0.95) allows."""
    rng = random.Random(5)
    letters = "abcdefghijklmnopqrstuvwxyz"
    word = lambda n: "".join(rng.choice(letters) for _ in range(n))
    vocabulary = [word(rng.randrange(2, 9)) for _ in range(4000)]

    def words_changed(line, share):
        words, left = line.split(), int(share * len(line))
        for i in rng.sample(range(len(words)), len(words)):
            if len(words[i]) <= left:
                left -= len(words[i])
                words[i] = word(len(words[i]))
        return " ".join(words)

    def letters_changed(line, share):
        out = list(line)
        for i in rng.sample([i for i, c in enumerate(line) if c != " "], int(share * len(line))):
            out[i] = rng.choice(letters)
        return "".join(out)

    cases, lines = [], []
    for n_words in (5, 12, 20, 32, 60, 150):
        for edit, share, least in ((words_changed, 0.1, 0.95), (letters_changed, 0.05, 0.95), (letters_changed, 0.1, 0.9 if n_words <= 20 else 0.6)):
            cases.append((n_words, edit.__name__, share, least))
            for _ in range(80):
                line = " ".join(rng.choices(vocabulary, k=n_words))
                lines += [line, edit(line, share)]
    first = {r.k: r.first.k for r in fuzzy_lines.line_groups(frame(lines)).collect()}
    for c, (n_words, name, share, least) in enumerate(cases):
        found = sum(first[i] == first[i + 1] for i in range(c * 160, c * 160 + 160, 2)) / 80
        assert found >= least, (n_words, name, share, found)


def test_lines_that_share_a_passage_only_are_no_pairs(frame):
    """A passage in many lines, at places too far apart for the similarity, gives no pairs; nor does it part lines that are alike."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6))
    passage = [word() for _ in range(30)]
    base = [[word() for _ in range(70)] for _ in range(40)]
    lines = [" ".join(words[: 2 * i] + passage + words[2 * i :]) for i, words in enumerate(base[:36])]
    copies = [line.replace(line.split()[50], "changed") for line in lines]
    docs = frame(lines + copies)
    first = {r.k: r.first.k for r in fuzzy_lines.line_groups(docs).collect()}
    assert first == {i: i % 36 for i in range(72)}
    members = fuzzy_lines._anchors(docs, "doc_id", "text", 0.9).alias("x")
    near = (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.id") < F.col("y.id"))
    met = members.join(members.alias("y"), near).select("x.id", "y.id", fuzzy_lines._aligned("x.", "y.", 0.9).alias("kept")).distinct()
    assert met.count() > 1000 and met.where("kept").count() < 700
    # Each line is cut into shingles once, and normalised once.
    plan = fuzzy_lines._anchors(docs, "doc_id", "text", 0.9)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") == 1 and plan.count("array_distinct(transform") == 1


def test_lattice_points_are_nearest():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(40, 8)) * 2
    points = lattice_hash.nearest_e8(x)
    twice = np.rint(points * 2)
    assert np.allclose(points * 2, twice) and (np.isin((twice % 2).sum(axis=1), (0, 8))).all() and (points.sum(axis=1) % 2 == 0).all()
    own = ((x - points) ** 2).sum(axis=1)
    for v in lattice_hash._MINIMAL:
        assert (own <= ((x - points - v) ** 2).sum(axis=1) + 1e-9).all()


def test_near_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(12, 24))
    vectors = [(c + rng.normal(size=24) * s).tolist() for c in centres for s in (0.0, 0.05, 0.1, 0.2, 0.3, 0.0)]
    vectors = [[float(np.float32(x)) for x in v] for v in vectors]
    odd = [None, [], [0.0] * 24, [float("nan")] + [1.0] * 23, [None] + [1.0] * 23, [float("inf")] * 24, [1.0, 0.0], [2.0, 0.0], [1e30] * 24, [1e-30] * 24]
    rows = [(i, v, 0) for i, v in enumerate(vectors + odd)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("id", F.lit("x")).withColumn("class", F.lit("y"))
    good = {i: np.array(v) / np.abs(v).max() for i, v, _ in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    links = [
        (a, b) for a, b in itertools.combinations(good, 2)
        if len(good[a]) == len(good[b]) and good[a] @ good[b] / np.linalg.norm(good[a]) / np.linalg.norm(good[b]) >= 0.9
    ]
    component = connected(range(len(rows)), links)
    degree = {i: sum(i in e for e in links) for i in range(len(rows))}
    for tiles in (2048, 3):
        got = {r.vec_id: (r.n_links, r.component_id) for r in lattice_hash.near_vectors(df, tile_rows=tiles).collect()}
        assert got == {i: (degree[i], component[i]) for i in range(len(rows))}
    assert lattice_hash.near_vectors(df.limit(0)).count() == 0


def test_recall_at_the_threshold():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(800, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = rng.normal(size=x.shape)
    y -= (x * y).sum(axis=1, keepdims=True) * x
    y = 0.9 * x + (1 - 0.81) ** 0.5 * y / np.linalg.norm(y, axis=1, keepdims=True)
    met = np.zeros(len(x), dtype=bool)
    for t in range(7):
        a, b = lattice_hash.cells(x, t, 4, 0.45), lattice_hash.cells(y, t, 4, 0.45)
        met |= (a[:, :, None] == b[:, None, :]).any(axis=(1, 2))
    assert met.mean() >= 0.97


@pytest.mark.parametrize("blocks", [8192, 16])
def test_bit_sliced_top_k_equals_brute_force(spark, blocks):
    rng = np.random.default_rng(8)
    vectors = [rng.normal(size=12).round(1).tolist() for _ in range(150)] + [[0.5] * 12] * 30
    odd = [None, [], [None] + [1.0] * 11, [float("nan")] * 12, [float("inf")] * 12, [1.0, -2.0], [1e6] * 12, [0.0] * 12]
    rows = [(i, v) for i, v in enumerate(vectors + odd)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("id", F.lit(1)).withColumn("block", F.lit(1))
    q = {i: [math.floor(64 * x) for x in v] for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v)}
    want = set()
    for i in (k for k in q if k % 20 == 0):
        scores = sorted((-sum(a * b for a, b in zip(q[i], q[j])), j) for j in q if j != i)[:20]
        want |= {(i, n + 1, j, -s) for n, (s, j) in enumerate(scores)}
    got = bitslices.top_k(df, df.where("vec_id % 20 = 0"), 20, block_rows=blocks, query_rows=blocks)
    assert {tuple(r) for r in got.select("query_id", "rank", "vec_id", "score").collect()} == want
    assert bitslices.top_k(df.limit(0), df, 20).count() == 0


def test_top_k_keeps_copies_of_a_repeated_row(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0])] * 5 + [(20, [1.0, 0.0])], "vec_id long, embedding array<double>")
    rows = bitslices.top_k(df, df.where("vec_id = 20"), 3).collect()
    assert [(r.rank, r.vec_id, r.score) for r in sorted(rows, key=lambda r: r.rank)] == [(i, 1, 4096) for i in (1, 2, 3)]


def test_top_k_of_repeated_queries(spark):
    df = spark.createDataFrame([(i, [float(i), 1.0]) for i in (1, 2, 3)] + [(20, [1.0, 0.0])] * 2 + [(20, [-1.0, 0.0])], "vec_id long, embedding array<double>")
    rows = bitslices.top_k(df, df.where("vec_id = 20"), 3).select("rank", "vec_id").collect()
    assert sorted(map(tuple, rows)) == [(1, 1), (1, 3), (2, 2), (2, 2), (3, 1), (3, 3)]
    for large in (1e12, 1e30):
        with pytest.raises(Exception, match="fit a long"):
            big = spark.createDataFrame([(20, [large]), (1, [large])], df.schema)
            bitslices.top_k(big, big, 3)


def test_mix_query_sql_is_whole():
    assert "LIMIT" not in queries.SQL["op3_raked_mix"].upper()


def test_signs_exclude_no_similar_lines(spark):
    """Edited lines at every distance up to the bound, and unrelated ones, most of which the signs exclude."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9)))
    rows = []
    for _ in range(400):
        x = y = " ".join(word() for _ in range(rng.randint(4, 60)))
        for _ in range(int(len(x) * 0.1 * rng.random())):
            at = rng.randrange(len(y))
            y = y[:at] + rng.choice(["", "q", "z" + y[at]]) + y[at + 1 :]
        rows += [(x, y), (x, " ".join(word() for _ in range(len(x.split()))))]
    pairs = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "n long, x string, y string")
    signs = [fuzzy_lines._signed(pairs.select(F.col("n").alias("id"), F.col(c).alias("body"))).select(F.col("id").alias("n"), F.col("sign").alias(f"{c}sign")) for c in "xy"]
    found = pairs.join(signs[0], "n", "left").join(signs[1], "n", "left").withColumns({"xlen": F.length("x"), "ylen": F.length("y")})
    most = F.greatest("xlen", "ylen") * 0.1 + 1e-9
    found = found.select((F.levenshtein("x", "y") <= most).alias("near"), fuzzy_lines._resembling("x", "y", 0.9).alias("kept"), (F.greatest("xlen", "ylen") <= 200).alias("short")).collect()
    assert sum(r.near for r in found) > 300 and all(r.kept for r in found if r.near)
    apart = [r.kept for r in found if not r.near and r.short]
    assert len(apart) > 100 and sum(apart) < len(apart) / 20


def test_unlike_lines_of_one_bucket_are_not_paired(spark, frame, monkeypatch):
    """Lines that share a passage and nothing else: their pairs grow with the square of the lines."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7))
    lines = [" ".join(word() for _ in range(5)) + " one passage that all of them share " + " ".join(word() for _ in range(5)) for _ in range(60)]
    lines += [lines[7][:-1] + "Q", lines[7][:-2] + "QX"]
    compared, verified = [], fuzzy_lines._verified

    def counted(*args):
        compared.append(next(a for a in args if hasattr(a, "columns") and a.columns == ["a", "b"]).count())
        return verified(*args)

    monkeypatch.setattr(fuzzy_lines, "_verified", counted)
    first = {r.k: r.first.k for r in fuzzy_lines.line_groups(frame(lines)).collect()}
    assert len(set(first.values())) == 60 and first[7] == first[60] == first[61]
    assert sum(compared) < 4 * 62


def test_long_lines_are_compared_whole(frame):
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(2000)]
    changed = lambda n: " ".join("zzzzz" if i % n == 3 else w for i, w in enumerate(words))
    other = " ".join(words[:40] + ["".join(rng.choice("klmnopqrst") for _ in range(5)) for _ in range(1960)])
    first = {r.k: r.first.k for r in fuzzy_lines.line_groups(frame([" ".join(words), changed(400), changed(12), other, changed(4)])).collect()}
    assert [first[i] for i in range(5)] == [0, 0, 0, 3, 4]


def test_a_written_table_leaves_no_shuffle_files(spark):
    from counterpoise.session import stage

    files = lambda: spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().size()
    before = files()
    stage(spark.range(100_000, numPartitions=4).groupBy((F.col("id") % 9_999).alias("k")).count(), "grouped")
    until = time.time() + 20
    while files() > before and time.time() < until:
        time.sleep(0.2)
    assert files() <= before
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None) in (None, "false")
