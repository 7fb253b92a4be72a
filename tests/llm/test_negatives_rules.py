"""Hard negatives and ratio rules against plain loops."""

import collections
import hashlib
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from counterpoise.llm import hard_negatives, ratio_rules


def plain_negatives(rows, k=5, positives=5, scale=256):
    good = {(i, y, tuple(v)) for i, v, y in rows if i is not None and y is not None and v and all(x is not None and math.isfinite(x) for x in v)}
    good = [(i, y, [math.floor(scale * x) for x in v]) for i, y, v in sorted(good)]
    out = []
    for i, y, q in (g for g in good if g[0] % 10 == 0):
        scored = sorted((-sum(a * b for a, b in zip(q, p)), j, z) for j, z, p in good if j != i)
        for s, j, _ in [x for x in scored if x[2] == y][:positives]:
            fit = [(t, n) for t, n, z in scored if z != y and 80 * -s <= 100 * -t <= 100 * -s][:k]
            out += [(i, j, r + 1, n, -s, -t) for r, (t, n) in enumerate(fit)]
    return sorted(out)


@pytest.mark.parametrize("blocks", [8192, 13])
def test_negatives_equal_brute_force(spark, blocks):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.integers(-3, 9, 6) / 4], int(rng.integers(3))) for i in range(160)]
    rows += [(i, [1.0] * 6, i % 3) for i in range(160, 190)]
    rows += rows[:20] + [(7, [0.5] * 6, 1), (10, [0.25] * 6, 2), (10, [2.0] * 6, 0)]
    rows += [(300, None, 1), (310, [], 1), (320, [None] + [1.0] * 5, 1), (330, [float("nan")] * 6, 1), (340, [float("inf")] * 6, 0), (350, [1.0] * 6, None)]
    rows += [(None, [1.0] * 6, 0), (360, [1.0, 2.0], 1), (370, [0.0] * 6, 1), (380, [-1.0] * 6, 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    for name in ("r", "id", "q", "n", "slot", "score", "anchor", "block", "chunk"):
        df = df.withColumn(name, F.lit(name))
    got = hard_negatives.hard_negatives(df, F.col("vec_id") % 10 == 0, block_rows=blocks, anchor_rows=blocks)
    assert sorted(map(tuple, got.collect())) == plain_negatives(rows)
    assert hard_negatives.hard_negatives(df.limit(0), F.col("vec_id") % 10 == 0).count() == 0


def test_negatives_of_large_components_are_exact(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.integers(10**5, 10**6, 4)], i % 3) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert sorted(map(tuple, hard_negatives.hard_negatives(df, F.col("vec_id") % 10 == 0).collect())) == plain_negatives(rows)
    rows[0] = (0, [1e12] * 4, 0)
    with pytest.raises(ValueError):
        hard_negatives.hard_negatives(spark.createDataFrame(rows, df.schema), F.col("vec_id") % 10 == 0)


def plain_rules(rows, labels):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    trusted = {i for i, q in labels if q == 1}
    counts = [collections.Counter(), collections.Counter()]
    found = []
    for (i, _), w in zip(rows, words):
        h = [int(hashlib.md5(x.encode()).hexdigest()[:7], 16) for x in w]
        found.append([x % ratio_rules.BUCKETS for x in h] + [(x * 1000003 + y) % (2**31 - 1) % ratio_rules.BUCKETS for x, y in zip(h, h[1:])])
        counts[0].update(found[-1])
        if i in trusted:
            counts[1].update(found[-1])
    raw, good = (lambda b, c=c: math.log((c[b] + 1) / (sum(c.values()) + ratio_rules.BUCKETS)) for c in counts)
    out = []
    for (i, t), w, f in zip(rows, words, found):
        t = t or ""
        windows = list(zip(w, w[1:], w[2:]))
        often = collections.Counter(windows)
        repeated = {p + d for p, x in enumerate(windows) if often[x] > 1 for d in range(3)}
        lines = [line for line in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
        score = sum(good(b) - raw(b) for b in f) / len(f) if f else 0.0
        failed = len(w) < 50 or 100 * len(repeated) > 50 * len(w)
        kept = not failed and score >= ratio_rules.THRESHOLD
        out.append((i, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(repeated), failed, kept, round(score, 9)))
    return out


def test_rules_equal_brute_force(spark, frame, odd, monkeypatch):
    rng = np.random.default_rng(5)
    good = [" ".join(rng.choice([f"w{i}" for i in range(40)], 80)) for _ in range(20)]
    junk = [" ".join(rng.choice([f"j{i}#" for i in range(40)], 80)) for _ in range(20)]
    texts = [*good, *junk, *odd, "a b c d a b c\n\n a b c\nx\nx\nx ", "a b c " * 30, good[0]]
    rows = list(enumerate(texts)) + [(3, texts[3]), (None, texts[0])]
    labels = [(i, 1) for i in range(10)] + [(i, 0) for i in range(20, 25)] + [(3, 0), (3, 1), (26, None), (None, 1)]
    table = spark.createDataFrame(labels, "doc_id long, quality int")
    for remembered in (1 << 20, 10):
        monkeypatch.setattr(ratio_rules, "_REMEMBERED", remembered)
        docs = frame(rows)
        out = ratio_rules.judged(docs, ratio_rules.fit(docs, table))
        assert out.columns == [*docs.columns, "rules"]
        got = [(r.doc_id, *r.rules[:5], r.rules.base_failed, r.rules.kept, round(r.rules.score, 9)) for r in out.collect()]
        want = plain_rules(rows, [x for x in labels if x[0] is not None])
        assert sorted(got, key=str) == sorted(want, key=str)
    kept = {r.doc_id for r in ratio_rules.keep_good(docs, table).collect()}
    assert set(range(20)) <= kept and not kept & set(range(20, 40))
    empty = frame([])
    assert ratio_rules.judged(empty, ratio_rules.fit(empty, table)).count() == 0
    unlabelled = ratio_rules.judged(docs, ratio_rules.fit(docs, table.limit(0)))
    assert unlabelled.count() == len(rows)


def test_target_of_a_bounded_sample(spark, frame):
    docs = frame([f"w{i % 50} v{i % 7} u{i % 3}" for i in range(2000)])
    labels = docs.select("doc_id", F.lit(1).alias("quality"))
    whole, part = (ratio_rules.fit(docs, labels, buckets=32, trusted_rows=n).logs for n in (5000, 500))
    assert np.allclose(whole, 0) and 0 < np.abs(part).max() < 0.6


def test_target_of_all_trusted_documents(spark, frame):
    docs = frame([f"w{i % 50} v{i % 7} u{i % 3}" for i in range(2000)])
    labels = spark.range(600_000).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        for threshold in (before, "-1"):
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
            assert np.allclose(ratio_rules.fit(docs, labels, buckets=32).logs, 0)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_texts_are_not_shuffled_to_trusted_keys(spark, frame, monkeypatch):
    rows = [(i if i % 11 else None, f"w{i % 50} v{i % 7} u{i % 3}") for i in range(500)] + [(7, "twice the key")]
    docs, good = frame(rows), [i for i in range(500) if i % 3 == 0]
    labels = spark.createDataFrame([(i, 1) for i in good] + [(None, 1)], "doc_id long, quality int")
    trusted = [t for i, t in rows if i is not None and i % 3 == 0]
    want = collections.Counter(b for _, t in rows for w in [t.split()] for b in grams_of(w))
    target = collections.Counter(b for t in trusted for b in grams_of(t.split()))
    plans, plain = [], type(docs).mapInArrow
    monkeypatch.setattr(type(docs), "mapInArrow", lambda df, *a, **k: plans.append(df._jdf.queryExecution().toString()) or plain(df, *a, **k))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        # With 64 bits nearly every key shares one with a trusted key.
        for bits in (1 << 26, 64):
            monkeypatch.setattr(ratio_rules, "_MOST_BITS", bits, raising=False)
            plans.clear()
            logs = ratio_rules.fit(docs, labels, buckets=32).logs
            share = lambda c: np.log((np.array([c[b] for b in range(32)]) + 1) / (sum(c.values()) + 32))
            assert np.allclose(logs, share(target) - share(want))
            assert "Join" not in plans[0] and "Exchange" not in plans[0]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def grams_of(words):
    hashes = np.array([int(hashlib.md5(w.encode()).hexdigest()[:7], 16) for w in words], dtype=np.int64)
    return ratio_rules.grams(hashes, 32).tolist()


def test_windows_of_many_words():
    rng = np.random.default_rng(6)
    for n, kinds in ((0, 1), (3, 1), (4, 1), (500, 6), (3_000_000, 2_900_000)):
        x = rng.integers(0, kinds, n)
        windows = collections.Counter(zip(x[:-2].tolist(), x[1:-1].tolist(), x[2:].tolist())) if n < 1000 else None
        got = ratio_rules.repeated_words(x)
        if windows is not None:
            assert got == len({p + d for p in range(n - 2) if windows[(x[p], x[p + 1], x[p + 2])] > 1 for d in range(3)})
        else:
            assert got == ratio_rules.repeated_words(x + 5)
