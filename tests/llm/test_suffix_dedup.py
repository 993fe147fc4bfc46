import hashlib
import random
import tracemalloc
from collections import Counter

import pyarrow as pa
import pytest

from blockloom.llm import interval, suffix_dedup


def brute(texts, length):
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        cover = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                cover[i : i + length] = b"\1" * length
        spans = sum(1 for i, c in enumerate(cover) if c and (not i or not cover[i - 1]))
        kept = bytes(b for b, c in zip(t, cover, strict=True) if not c)
        out.append((len(t), sum(cover), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("length,most", [(40, 10**6), (40, 200), (24, 10**6), (61, 900)])
def test_equals_brute_force(docs, corpus, length, most):
    """With ``most`` low, anchors take the path for hot ones."""
    want = Counter(zip([i for i, *_ in corpus], brute([(t or "").encode() for _, t, *_ in corpus], length), strict=True))
    got = Counter((r.doc_id, (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)) for r in suffix_dedup.suffix_dedup(docs, length, digest=True, most=most).collect())
    assert got == want


def test_periodic_and_binary_like_texts(spark):
    rnd = random.Random(4)
    rows = [(1, "a" * 500), (2, "ab" * 300), (3, "abc" * 50 + "x" + "abc" * 50), (4, "\0" * 90 + "z"), (5, "\0" * 30), (6, "".join(rnd.choice("ab") for _ in range(3000))), (7, "é" * 200)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    for most in (10**6, 100):
        got = sorted((r.doc_id, (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)) for r in suffix_dedup.suffix_dedup(frame, 40, digest=True, most=most).collect())
        assert got == list(zip([i for i, _ in rows], brute([t.encode() for _, t in rows], 40), strict=True))


def test_long_texts_are_cut_into_overlapping_pieces(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PIECE", 300)
    rnd = random.Random(5)
    base = "".join(rnd.choice("abcdefgh ") for _ in range(1000))
    rows = [(1, base), (2, "x" + base[150:700] + "y"), (3, base[690:760])]
    got = sorted((r.doc_id, (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)) for r in suffix_dedup.suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string"), 60, digest=True).collect())
    assert got == list(zip([1, 2, 3], brute([t.encode() for _, t in rows], 60), strict=True))


@pytest.mark.parametrize("size,n", [(4_000, 2_000), (8_000_000, 1)])
def test_runs_are_found_in_little_memory(size, n):
    """Two workers share an executor with its JVM: many texts, or a long one, must not take hundreds of megabytes."""
    data = random.Random(6).randbytes(size * n)
    batch = pa.RecordBatch.from_pydict({"doc_id": range(n), "rid": range(n), "text": [data[i * size : (i + 1) * size] for i in range(n)]})
    tracemalloc.start()
    windows = sum(((r >> 16 & 0xFFFF) + 1) for out in suffix_dedup._runs(400, 120)(iter([batch])) for r in out.column("loc").to_pylist())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert windows == n * (size - 399)
    assert peak < 160_000_000


def test_interval_expansion_equals_counting():
    rnd = random.Random(1)
    for _ in range(150):
        length = rnd.choice([3, 5, 8, 9, 20, 33])
        base = bytes(rnd.choice(b"ab") for _ in range(60))
        texts = []
        for _ in range(rnd.randint(1, 6)):
            t = bytearray(base[rnd.randint(0, 20) : rnd.randint(30, 60)] if rnd.random() < 0.7 else bytes(rnd.choice(b"ab\0") for _ in range(rnd.randint(0, 50))))
            if t and rnd.random() < 0.5:
                t[rnd.randrange(len(t))] = rnd.choice(b"abc")
            texts.append(bytes(t))
        weights = [rnd.choice([1, 1, 2]) for _ in texts]
        seen = Counter()
        for t, w in zip(texts, weights, strict=True):
            for i in range(len(t) - length + 1):
                seen[t[i : i + length]] += w
        for t, found in zip(texts, interval.repeated_starts(texts, weights, length), strict=True):
            assert found.tolist() == [seen[t[i : i + length]] >= 2 for i in range(len(t) - length + 1)]


def test_empty_table(none):
    assert suffix_dedup.suffix_dedup(none).count() == 0
