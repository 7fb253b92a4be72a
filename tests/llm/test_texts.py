"""Personal data, quality, encoding and the lattice model."""

import collections
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from counterpoise.llm import encoding, hashing, pieces, pii, quality, queries, subword_lm


def base_by_regex(text):
    digits = lambda s: [int(c) for c in s if c.isdigit()]

    def luhn(s):
        d = digits(s)[::-1]
        return sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(d)) % 10 == 0

    rules = [
        (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        (r"[0-9]([\x20-]?[0-9])+", lambda s: 12 <= len(digits(s)) <= 19 and luhn(s)),
        (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(digits(s)) <= 15),
    ]
    return sorted((m.start(), k, m.end()) for k, (p, good) in enumerate(rules) for m in re.finditer(p, text or "") if good(m[0]))


def test_base_spans_equal_the_patterns():
    rng = np.random.default_rng(3)
    for _ in range(4000):
        text = "".join(rng.choice(list("a1.@-+ 23(b)25")) for _ in range(rng.integers(0, 40)))
        assert pii.base_spans(text) == base_by_regex(text), text


def test_long_runs_are_read_in_linear_time():
    text = "a" * 200_000 + "@b.com " + "1" * 100_000 + " 4111111111111111"
    assert pii.written(pii.base_spans(text)).startswith("email:0:200006")


def test_semi_markov_recursions_equal_enumeration():
    rng = np.random.default_rng(0)
    for zone in ("12 4111 1111 1111 1111 7", "tel (736) 555-2678 x", "a at b dot com 1.2.3.4.5"):
        borders, segments = pii._candidates(zone, [])
        segments = [segments[i] for i in rng.permutation(len(segments))[:9]]
        weights = rng.normal(size=pii.PRIOR.shape)
        options = []
        for mask in range(1 << len(segments)):
            chosen = sorted((segments[i] for i in range(len(segments)) if mask >> i & 1), key=lambda s: s[:2])
            if all(a[1] <= b[0] for a, b in zip(chosen, chosen[1:])):
                touching = sum(a[1] == b[0] for a, b in zip(chosen, chosen[1:])) * pii.TOUCHING
                options.append((sum(float(weights[k] @ v) for _, _, k, v in chosen) + touching, mask, [s[:3] for s in chosen]))
        total, chance = pii.expected(len(borders) - 1, segments, weights)
        assert total == pytest.approx(np.logaddexp.reduce([o[0] for o in options]))
        for n in range(len(segments)):
            assert chance[n] == pytest.approx(sum(math.exp(o[0] - total) for o in options if o[1] >> n & 1), abs=1e-9)
        best = max(options)
        got = pii.decode(len(borders) - 1, segments, weights)
        score = {s[:3]: float(weights[s[2]] @ s[3]) for s in segments}
        value = sum(score[g] for g in got) + sum(a[1] == b[0] for a, b in zip(got, got[1:])) * pii.TOUCHING
        assert value == pytest.approx(best[0])


def test_personal_data_found_and_clean_numbers_left(frame, odd):
    hard = ["card 12 4111 1111 1111 1111 ok", "write jane.doe [at] mail [dot] org", "tel (736) 555-2678 now", "19 192[.]168[.]1[.]20"]
    clean = ["on 2024-01-31 at 10:15", "version 3.11.2 of 1.0", "order 123456789012", "we met at noon and dot the i", "page 12 of 1999"]
    easy = ["mail bosbt.42@mail8.example.com and 42.144.35.254 or +1 (736) 555-2678, 4041894974608795"]
    rows = {r.doc_id: r for r in pii.find_personal_data(frame(hard + clean + easy + odd)).collect()}
    assert [rows[i].n_added for i in range(len(hard))] == [1] * len(hard)
    assert all(rows[len(hard) + i].spans == "" for i in range(len(clean)))
    r = rows[len(hard) + len(clean)]
    assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == (1, 1, 1, 1) and r.spans.count(":") == 8
    assert pii.find_personal_data(frame([])).count() == 0


def test_personal_data_in_a_zone_as_long_as_the_text():
    """A hundred thousand characters of numbers in one zone: under 40 bytes of memory a character."""
    import tracemalloc

    text = "tel +1 (736) 555-2678, 4111 1111 1111 1111; " * 2_500
    assert list(pii._zones(text)) == [(0, len(text))]
    pii.find_spans(text[:400], pii.PRIOR)
    tracemalloc.start()
    base, every = pii.find_spans(text, pii.PRIOR)
    results, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert len(base) == 5_000 <= len(every) and peak - results < 40 * len(text)


def test_personal_data_sample_does_not_depend_on_files(spark):
    rows = [(i, f"call 555{i:05d} or a{i}@b.org") for i in range(3_000)] + [(9_000 + i, "no sign") for i in range(500)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    one, many = pii.sample_texts(df.coalesce(1), sample_rows=40), pii.sample_texts(df.orderBy(F.col("doc_id").desc()).repartition(13), sample_rows=40)
    assert one == many and len(set(one)) == 40


def test_personal_data_examples_come_from_every_kind_and_text(monkeypatch):
    seen = []
    monkeypatch.setattr(pii, "_examples", lambda zone, spans: seen.append((zone, spans)) or [(zone, spans)])
    mails = ["mail a%d@b.org now" % i + "\n" + "x" * 300 + "\nmail c@d.org" for i in range(100)]
    rare = ["ip 42.144.35.254", "pay 4111 1111 1111 1111", "tel +1 (736) 555-2678"]
    pii.fit(mails + rare, zones=40, steps=1)
    assert {s[0][1] for _, s in seen if s} == {0, 1, 2, 3} and len({z for z, _ in seen if "a" in z and "@b" in z}) >= 30


def test_quality_separates_held_out_rows(spark, small):
    scored = quality.score_documents(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet"))
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").where(quality.held_out("doc_id"))
    rows = scored.join(labels, "doc_id").select("score", "quality").collect()
    assert np.mean([(r.score >= 0.5) == r.quality for r in rows]) > 0.95


def test_discriminant_equals_the_densities():
    rng = np.random.default_rng(1)
    d = len(quality.FEATURES)
    means, covariances = rng.normal(size=(2, d)), [np.cov(rng.normal(size=(d, 60))) + np.eye(d) for _ in range(2)]
    factors = np.array([np.linalg.cholesky(c) for c in covariances])
    model = quality.Discriminant(0.3, means, factors, np.array([math.log(p) - np.log(np.diag(f)).sum() for p, f in zip((0.7, 0.3), factors)]))
    x = rng.normal(size=(5, d))
    logs = [
        math.log(p) - 0.5 * np.linalg.slogdet(c)[1] - 0.5 * np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m)
        for p, m, c in zip((0.7, 0.3), means, covariances)
    ]
    assert model.score(x) == pytest.approx(1 / (1 + np.exp(logs[0] - logs[1])))


def test_quality_edges(spark, frame, odd):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(5)] + [(3, None, 0)], "doc_id long, quality int, toxic int")
    docs = frame(odd)
    scores = [r.score for r in quality.score_documents(docs, labels).collect()]
    assert len(scores) == len(odd) and all(0 <= s <= 1 for s in scores)
    assert {r.score for r in quality.score_documents(docs, labels.limit(0)).collect()} == {0.5}
    kept = quality.keep_good(docs, labels.limit(0))
    assert kept.count() == len(odd) and kept.columns == docs.columns
    assert quality.score_documents(frame([]), labels).count() == 0


def unigram_library(vocabulary):
    """The library's own unigram search over the same pieces and scores."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    with open(pieces.VOCABULARY, "rb") as f:
        proto.ParseFromString(f.read())
    proto.trainer_spec.model_type = 1
    for piece, log, kind in zip(proto.pieces, vocabulary.logs, vocabulary.kind):
        piece.score = float(log) if kind != 2 else 0.0
    return sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())


@pytest.fixture(scope="module")
def vocabulary():
    return encoding._ready(pieces.VOCABULARY)


def test_encoding_reaches_the_best_score_and_round_trips(vocabulary, odd):
    import pyarrow.parquet as pq

    texts = pq.read_table("/root/testdata/sf0.001/documents.parquet")["text"].to_pylist()[:120] + odd + ["▁x ▁▁", "  a  b\t\n ", " "]
    ids = encoding.encode_texts(vocabulary, pa.array(texts))
    library = unigram_library(vocabulary)
    for text, own, back in zip(texts, ids.to_pylist(), encoding.decode_ids(vocabulary, ids)):
        assert (own is None and back is None) if text is None else back == text.encode()
        if text and "▁" not in text:
            score = lambda x: float(vocabulary.logs[x].sum())
            assert score(own) == pytest.approx(score(library.encode(text)), rel=1e-6)


def test_streaming_equals_lockstep_and_commits_early(vocabulary):
    rng = np.random.default_rng(2)
    words = ["".join(rng.choice(list("abcdeéßtion.1漢▁"), size=rng.integers(1, 45))) for _ in range(300)]
    ids, at = pieces.best_ids(vocabulary, words)
    for i, word in enumerate(words):
        stream = pieces.StreamingViterbi(vocabulary)
        assert [*stream.feed(pieces._codes([word])[0].tolist()), *stream.close()] == ids[at[i] : at[i + 1]].tolist()
    stream, most = pieces.StreamingViterbi(vocabulary), 0
    for code in pieces._codes(["thequickbrownfox" * 2000])[0].tolist():
        list(stream.feed([code]))
    stream = pieces.StreamingViterbi(vocabulary)
    for n in range(400):
        list(stream.feed(pieces._codes(["thequickbrownfox"])[0].tolist() * 4))
        most = max(most, len(stream.text))
    assert most < 200


def test_lattice_sum_equals_enumeration(vocabulary):
    def every(codes):
        if not codes:
            yield 0.0
        for n in range(1, min(len(codes), vocabulary.longest) + 1):
            if n == 1 or "".join(map(chr, codes[:n])) in vocabulary.ids:
                ids = pieces.piece_ids(vocabulary, codes[:n])
                for rest in every(codes[n:]):
                    yield float(vocabulary.logs[ids].sum()) + rest

    words = [" the", " tionre", "é漢x", " 🙂a", "abcabcab"]
    want = [np.logaddexp.reduce(list(every(pieces._codes([w])[0].tolist()))) for w in words]
    assert pieces.log_sums(vocabulary, words) == pytest.approx(want)
    assert [pieces._long_log_sum(vocabulary, w) for w in words] == pytest.approx(want)
    weights = np.arange(1.0, 6.0)
    uses, eps = pieces.expected_uses(vocabulary, words, weights), 1e-6
    for piece in (" the".replace(" ", "▁"), "ab"):
        i = vocabulary.ids[piece]
        logs = vocabulary.logs.copy()
        logs[i] += eps
        slope = weights @ (pieces.log_sums(vocabulary.with_logs(logs), words) - want) / eps
        assert uses[i] == pytest.approx(slope, rel=1e-3, abs=1e-4)


def test_lm_counts_and_scores(spark, frame, odd):
    texts = ["The cat sat", "the dog\tsat  down", "THE cat ÉTÉ"] * 6 + odd
    for head_words in (0, 5, 200_000):
        rows = subword_lm.score_documents(frame(texts), head_words=head_words).collect()
        words = {i: (t or "").encode().lower().split() + [None] for i, t in enumerate(texts)}
        counts = collections.Counter(w for i, ws in words.items() if zlib.crc32(str(i).encode()) % 5 != 1 for w in ws)
        n = sum(counts.values())
        for r in rows:
            own = words[r.doc_id]
            assert (r.n_tokens, r.n_known, r.train_tokens) == (len(own), sum(counts[w] > 0 for w in own), n)
            assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (len(counts) + 1))) for w in own))
            assert r.score < 0 and math.isfinite(r.score)
        if head_words == 0:
            first = {r.doc_id: r.score for r in rows}
        assert {r.doc_id: pytest.approx(r.score) for r in rows} == first
    assert subword_lm.score_documents(frame([])).count() == 0
    only_held = subword_lm.score_documents(frame([(k, "a b") for k in range(40) if zlib.crc32(str(k).encode()) % 5 == 1])).collect()
    assert only_held and all(math.isfinite(r.score) and r.train_tokens == 0 for r in only_held)


def test_word_hashes_follow_the_words(odd):
    texts = odd + ["Ab  cD\x0be\x0c f", "ab cd e f", " lead", "trail ", "w" * 2_500_000 + " x"]
    data, offsets = hashing.text_buffers(pa.array(texts))
    hashes, at, _, lengths = hashing.word_hashes(data, offsets)
    seen = {}
    for i, text in enumerate(texts):
        words = (text or "").encode().lower().split()
        assert at[i + 1] - at[i] == len(words) and lengths[at[i] : at[i + 1]].tolist() == [len(w) for w in words]
        for word, h in zip(words, hashes[at[i] : at[i + 1]].tolist()):
            assert seen.setdefault(word, h) == h
    assert len(set(seen.values())) == len(seen)


def test_queries_are_registered():
    assert [any(q.startswith(f"op{n}_") for q in queries.QUERIES) for n in range(1, 11)] == [True] * 10


def test_queries_equal_their_sql(spark):
    from tests.oracle import compare, connect

    con = connect("/root/testdata/sf0.001")
    for name, sql in queries.SQL.items():
        assert compare(spark, con, name, queries.QUERIES[name], sql, "/root/testdata/sf0.001")[0] is None, name


def test_columns_encode_and_decode(frame, odd):
    rows = frame(odd).select("text", encoding.encode("text").alias("ids")).select("text", encoding.decode("ids").alias("back")).collect()
    assert all(r.text == r.back for r in rows)
    assert frame(odd).where(F.lit(False)).select(encoding.encode("text").alias("ids")).count() == 0


def thue_morse(n):
    """Two words that no polynomial hash modulo a power of two tells apart."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_structured_words_are_told_apart(frame):
    from counterpoise.llm import minhash, subword_lm

    x, y = thue_morse(4096)
    column = pa.array([x, y, f"{x} {y}"])
    data, offsets = hashing.text_buffers(column)
    hashes, at, _, _ = hashing.word_hashes(data, offsets)
    assert len(set(hashes.tolist())) == 2 and at.tolist() == [0, 1, 2, 4]
    docs = frame([x, y, x])
    rows = docs.select("doc_id", "text", encoding.encode_checked("text").alias("e")).collect()
    assert all(r.e.exact for r in rows) and rows[0].e.ids != rows[1].e.ids
    assert [r.component_id for r in minhash.near_duplicates(docs).orderBy("doc_id").collect()] == [0, 1, 0]
    known = {r.doc_id: r.n_known for r in subword_lm.score_documents(docs.union(docs.where("doc_id = 0"))).collect()}
    assert set(known) == {0, 1, 2}


def test_range_hashes_follow_the_bytes_alone(monkeypatch):
    rng = np.random.default_rng(3)
    data = rng.integers(0, 256, 5000).astype(np.uint8)
    data[3000:3400] = data[100:500]
    starts, ends = np.array([100, 3000, 101, 0, 4999, 7]), np.array([500, 3400, 500, 5000, 5000, 7])
    whole = hashing.range_hashes(data, starts, ends)
    assert whole[0] == whole[1] and len(set(whole.tolist())) == 5
    hashing._tables.cache_clear()
    monkeypatch.setattr(hashing, "PIECE", 64)
    assert (hashing.range_hashes(data, starts, ends) == whole).all()
    hashing._tables.cache_clear()


def test_chunks_of_one_hash_are_compared(vocabulary, monkeypatch):
    monkeypatch.setattr(encoding, "range_hashes", lambda data, starts, ends: (ends - starts).astype(np.uint64) % np.uint64(3))
    texts = ["one two three", "six ten", "three two one", None, ""]
    ids = encoding.encode_texts(vocabulary, pa.array(texts))
    assert [b.decode() if b is not None else None for b in encoding.decode_ids(vocabulary, ids)] == texts
