import hashlib
import re

import xxhash
from pyspark.sql import functions as F

from blockloom.llm import sketch


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def brute(text, k=128, words=5):
    parts = [w for w in re.split(r"[\x20\x09-\x0D]+", (text or "").lower()) if w]
    shingles = [parts[i : i + words] for i in range(len(parts) - words + 1)] or ([parts] if parts else [])

    def h(ws):
        seed = 42
        for w in ws:
            seed = xxhash.xxh64_intdigest(w.encode(), seed)
        return signed(seed)

    return sorted({h(s) for s in shingles})[:k]


def near(a, b, k=128):
    u = sorted({*a, *b})[:k]
    return 1.0 if not u else len([x for x in u if x in a and x in b]) / len(u)


def test_edited_fingerprints_equal_brute_force(docs, corpus):
    got = {}
    for r in sketch.edited_fingerprints(docs).collect():
        got.setdefault((r.doc_id, r.n_chars), []).append(r)
    ring = sorted([(i, t or "") for i, t, *_ in corpus if i is not None], key=lambda x: -x[0]) + [(None, "no id here")]
    assert sum(map(len, got.values())) == len(ring)
    for at, (doc_id, text) in enumerate(ring):
        after = ring[(at + 1) % len(ring)][1]
        n = len(text)
        m = n // 3
        edited = text[: n - m] + after[:m]
        digest = hashlib.sha256(edited.encode()).hexdigest()
        row = next((r for r in got[doc_id, n] if r.edited_sha256 == digest), None)  # repeated ids have several rows
        assert row, doc_id
        a, b, c = brute(text), brute(edited), brute(after)
        assert row.fingerprint == "".join(f"{x & (1 << 64) - 1:016x}" for x in a)
        assert row.edited_fingerprint == "".join(f"{x & (1 << 64) - 1:016x}" for x in b)
        assert abs(row.near_edited - near(a, b)) < 1e-12 and abs(row.near_next - near(a, c)) < 1e-12


def test_ring_over_many_ranges(spark):
    rows = spark.range(0, 997).select((F.col("id") * 7 % 10007).alias("doc_id"), F.concat(F.lit("t"), F.col("id")).alias("text")).withColumn("rid", F.xxhash64("text"))
    found = sketch.with_next(sketch.dealt_by_range(rows, rows_per_bucket=10), ["text"]).select("doc_id", "text", "next_text").collect()
    by_id = sorted(((r.doc_id, r.text) for r in found), reverse=True)
    after = {d: by_id[(i + 1) % len(by_id)][1] for i, (d, _) in enumerate(by_id)}
    assert len(found) == 997 and all(after[r.doc_id] == r.next_text for r in found)


def test_merge_equals_sketch_of_the_whole(spark):
    parts = [("a", f"p{i} q r s t{i} u v w x{i}") for i in range(700)] + [("b", None), ("b", "one two three four five six")]
    frame = sketch.with_sketch(spark.createDataFrame(parts, "k string, text string"), "text", "s")
    got = {r.k: r.s for r in sketch.merge_sketches(frame, "k", "s", fan_in=32).collect()}
    for key in "ab":
        whole = sorted({h for k, t in parts if k == key for h in brute(t, 10**9)})[:128]
        assert got[key] == whole
    est = frame.select(sketch.distinct_shingles(F.lit(got["a"])).alias("n")).first().n
    true = len({h for k, t in parts if k == "a" for h in brute(t, 10**9)})
    assert abs(est / true - 1) < 0.3


def test_containment(spark):
    small, large = " ".join(f"w{i}" for i in range(40)), " ".join(f"w{i}" for i in range(100))
    f = sketch.with_sketch(sketch.with_sketch(spark.createDataFrame([(small, large)], "a string, b string"), "a", "sa"), "b", "sb")
    row = f.select(sketch.containment(F.col("sa"), F.col("sb")).alias("c"), sketch.resemblance(F.col("sa"), F.col("sb")).alias("r")).first()
    assert row.c == 1.0 and abs(row.r - 36 / 96) < 1e-12


def test_empty_table_and_one_document(docs, none):
    assert sketch.edited_fingerprints(none).count() == 0 and sketch.fingerprints(none).count() == 0
    one = sketch.edited_fingerprints(docs.filter("doc_id = 2004")).first()
    assert one.near_next == 1.0 and one.n_chars == 9


def test_hot_ids_and_rows_in_buckets_of_their_own(spark, monkeypatch):
    """A third of the rows have one id, a third none, and of each some are alike; ranges are cut twice."""
    rows = [(7, f"hot words number {i // 3}") for i in range(300)] + [(None, f"nameless words {i % 90}") for i in range(300)] + [(100 + i, f"own words {i}") for i in range(300)] + [(8, "the very same text")] * 200
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("rid", sketch.row_key())
    dealt = sketch.dealt_by_range(frame, rows_per_bucket=10, ranges=4, finer=3)
    assert max(r["count"] for r in dealt.groupBy("bucket").count().collect()) <= 60
    monkeypatch.setattr(sketch.dealt_by_range, "__defaults__", (10, 4, 3))
    got = sketch.edited_fingerprints(frame.drop("rid")).collect()
    rid = {(r.doc_id, r.text): r.rid for r in frame.collect()}
    ring = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, rid[r]), reverse=True)
    want = []
    for at, (doc_id, text) in enumerate(ring):
        after = ring[(at + 1) % len(ring)][1]
        m = len(text) // 3
        want.append((doc_id, hashlib.sha256((text[: len(text) - m] + after[:m]).encode()).hexdigest(), near(brute(text), brute(after))))
    key = lambda r: (r[0] is not None, r[0] or 0, *r[1:])
    assert sorted(((r.doc_id, r.edited_sha256, r.near_next) for r in got), key=key) == sorted(want, key=key)
