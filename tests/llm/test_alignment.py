"""Cross-tokenizer alignment against plain loops over tokens."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from counterpoise.llm import alignment


@pytest.fixture(scope="module")
def both():
    return alignment.loaded(alignment.TOKENIZERS)


def plain(both, texts):
    """What each row holds, straight from the definition."""
    rows = []
    for text in texts:
        whole = f" {text}".encode() if text else b""
        a = both.a.encode(f" {text}", add_special_tokens=False).ids if text else []
        b = both.b.encode(text) if text else []
        if b"".join(both.a_bytes[i] for i in a) != whole or b"".join(both.b_bytes[i] for i in b) != whole:
            a, b = [], []
        ends = [set(), set()]
        for side, (ids, table) in enumerate(((a, both.a_bytes), (b, both.b_bytes))):
            at = 0
            for i in ids:
                at += len(table[i])
                ends[side].add(at)
        cuts = ends[0] & ends[1]
        groups = []
        for ids, table, side in ((a, both.a_bytes, 0), (b, both.b_bytes, 1)):
            at, own, out = 0, [], []
            for i in ids:
                at += len(table[i])
                own.append(i)
                if at in cuts:
                    out.append(own)
                    own = []
            groups.append(out)
        groups = list(zip(*groups, strict=True))
        links = Counter((i, j) for x, y in groups for i in x for j in y)
        name = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        rows.append((len(a), len(b), len(groups), links, hashlib.sha256(name.encode()).hexdigest() if a else ""))
    counts = Counter(pair for row in rows for pair in row[3])
    top = {}
    for (i, _), c in counts.items():
        top[i] = max(top.get(i, 0), c)
    return [
        (n_a, n_b, n_groups, sum(links.values()), sum(n for p, n in links.items() if counts[p] == top[p[0]]), sum(n * counts[p] for p, n in links.items()), sha)
        for n_a, n_b, n_groups, links, sha in rows
    ]


def some_texts(odd):
    rng = random.Random(3)
    words = ["the", "café", "naïve", "漢字", "🙂🙂", "don't", "1234567", "ab\n\ncd", "<|endoftext|>", "<s>", "straße", "    ", "\t", "=====", "ﬁne", "Ελλάδα"]
    texts = [" ".join(rng.choices(words, k=rng.randrange(1, 60))) for _ in range(40)]
    return [*texts, *odd, "▁", "a▁b", " leading", "trailing ", *texts[:5], texts[0]]


@pytest.mark.parametrize("head", [alignment.HEAD, 40, 0])
def test_digest_equals_brute_force(spark, frame, odd, both, head):
    texts = some_texts(odd)
    got = alignment.alignment_digest(frame(texts), head=head).orderBy("doc_id").collect()
    assert [tuple(r)[1:] for r in got] == plain(both, texts)
    assert [r.doc_id for r in got] == list(range(len(texts)))


def test_rows_with_one_key_and_none(spark, frame, both):
    texts = [(1, "one two"), (1, "one two"), (1, "three"), (None, "one"), (None, None)]
    got = sorted(map(tuple, alignment.alignment_digest(frame(texts)).collect()), key=str)
    want = sorted([(k, *row) for (k, _), row in zip(texts, plain(both, [t for _, t in texts]))], key=str)
    assert got == want
    assert alignment.alignment_digest(frame([])).count() == 0


def test_alignments_hold_overlaps(spark, frame, both, odd):
    for row in alignment.alignments(frame(some_texts(odd))).collect():
        ends_a, ends_b = (np.cumsum([0, *[len(t[i]) for i in ids]]) for ids, t in ((row.a_ids, both.a_bytes), (row.b_ids, both.b_bytes)))
        assert ends_a[-1] == ends_b[-1]
        shared = {}
        i = j = 0
        while i < len(row.a_ids):
            n = min(ends_a[i + 1], ends_b[j + 1]) - max(ends_a[i], ends_b[j])
            shared[(i, j)] = n
            step_a, step_b = ends_a[i + 1] <= ends_b[j + 1], ends_b[j + 1] <= ends_a[i + 1]
            i, j = i + step_a, j + step_b
        assert {(x.a, x.b): x.bytes for x in row.links} == shared
        assert all(row.a_group[x.a] == row.b_group[x.b] for x in row.links)
        if row.a_group:
            assert row.a_group[0] == 0 and set(row.a_group) == set(row.b_group) == set(range(row.a_group[-1] + 1))


def test_long_texts_are_cut_where_nothing_changes(both, monkeypatch):
    rng = random.Random(4)
    words = ["over", "12", "don't", "漢字", "the\nend", "x" * 50, "...", " ", "É", "_", "a_b"]
    texts = [" ".join(rng.choices(words, k=400)) for _ in range(10)]
    whole = [both.encode([t]) for t in texts]
    monkeypatch.setattr(alignment, "_CALL", 20)
    for text, (a, b) in zip(texts, whole):
        cut_a, cut_b = both.encode([text])
        assert len(list(alignment._parts(text))) > 3
        assert cut_a[0].tolist() == a[0].tolist() and cut_b[0].tolist() == b[0].tolist()


def test_row_product_equals_dense(monkeypatch):
    rng = np.random.default_rng(5)
    monkeypatch.setattr(alignment, "_TERMS", 7)
    for shape in ((6, 9, 5), (1, 1, 1), (20, 3, 40), (4, 0, 3)):
        x, y = rng.integers(0, 3, shape[:2]), rng.integers(0, 3, shape[1:])

        def sparse(m):
            rows, columns = np.nonzero(m)
            return alignment.Csr(np.searchsorted(rows, np.arange(len(m) + 1)), columns, m[rows, columns], m.shape[1])

        def dense(m):
            out = np.zeros((m.rows, m.columns), dtype=np.int64)
            out[m.row_numbers(), m.indices] = m.values
            return out

        assert (dense(sparse(x).product(sparse(y))) == x @ y).all()
        assert (dense(sparse(x).transposed()) == x.T).all()
