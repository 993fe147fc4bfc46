import hashlib
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import xxhash

from blockloom.llm import simhash
from blockloom.llm.graph import connected_components
from blockloom.llm.line_dedup import apply_bitmaps, line_dedup
from blockloom.llm.license_scan import license_scan, oracle_sql


def test_line_dedup_equals_brute_force(docs, corpus, none):
    where = defaultdict(set)
    split = lambda t: (t or "").split("\n")
    key = lambda s: s.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    for i, t, *_ in corpus:
        for line in split(t):
            where[key(line)].add((i, t))
    for least in (2, 10):
        drop = {k for k, v in where.items() if k and len(v) >= least}
        want = Counter()
        for i, t, *_ in corpus:
            kept = [x for x in split(t) if key(x) not in drop]
            want[i, len(split(t)), len(split(t)) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()] += 1
        got = Counter(tuple(r) for r in apply_bitmaps(docs, line_dedup(docs, min_docs=least), digest=True).collect())
        assert drop and got == want
    assert apply_bitmaps(none, line_dedup(none), digest=True).count() == 0


def test_a_hot_line_is_counted_over_many_ranges(spark):
    rows = [(i, f"hot\nown {i}\n" + ("rare" if i < 9 else "often" if i < 20 else "x")) for i in range(3000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(16)
    got = {r.doc_id: (r.n_lines, r.n_dropped) for r in apply_bitmaps(frame, line_dedup(frame)).collect()}
    assert got == {i: (3, 1 if i < 9 else 2) for i in range(3000)}


def brute_fp(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)})) if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    bits = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            bits[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * bits[b] > len(shingles)) if shingles else 0


def test_simhash_groups_equal_brute_force(docs, corpus, none):
    prints = [(i, brute_fp(t)) for i, t, *_ in corpus]
    parent = list(range(len(prints)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in range(len(prints)):
        for b in range(a):
            if (prints[a][1] ^ prints[b][1]).bit_count() <= 2:
                parent[root(a)] = root(b)
    least = defaultdict(list)
    for k, (i, _) in enumerate(prints):
        least[root(k)].append(i)
    want = Counter((i, f"{fp:016x}", min((x for x in least[root(k)] if x is not None), default=None)) for k, (i, fp) in enumerate(prints))
    got = Counter((r.doc_id, r.fingerprint, r.component_id) for r in simhash.simhash_groups(docs).collect())
    assert got == want and simhash.simhash_groups(none).count() == 0


def test_pairs_in_crowded_buckets(spark):
    """A cloud of near values, more than a bucket compares pairwise, and chains through it."""
    rng = np.random.default_rng(2)
    base = int(rng.integers(1, 1 << 62))
    values = {base} | {base ^ (1 << int(a)) ^ (1 << int(b)) ^ (1 << int(c)) for a, b, c in rng.integers(0, 16, (700, 3))} | {int(x) for x in rng.integers(1, 1 << 62, 300)}
    values = sorted(values)
    frame = spark.createDataFrame([(v,) for v in values], "fp long")
    edges = simhash.near_pairs(frame)
    assert all((r.u ^ r.v).bit_count() <= 2 for r in edges.collect())
    found = {r.node: r.root for r in connected_components(edges).collect()}
    parent = {v: v for v in values}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for i, a in enumerate(values):
        for b in values[:i]:
            if (a ^ b).bit_count() <= 2:
                parent[max(root(a), root(b))] = min(root(a), root(b))
    assert {v: found.get(v, v) for v in values} == {v: root(v) for v in values}


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(500, 501), (7, 7), (501, 500)], "u long, v long")
    assert {r.node: r.root for r in connected_components(edges).collect()} == {i: 0 for i in range(301)} | {500: 500, 501: 500}
    assert connected_components(edges.filter("u < 0")).count() == 0


def test_license_scan_equals_sql(docs, corpus, none):
    documents = docs.select("doc_id", "text").filter("doc_id IS NOT NULL AND doc_id != 2007").toPandas()  # noqa: F841
    want = sorted(map(str, duckdb.sql(oracle_sql().replace("FROM documents", "FROM documents WHERE doc_id IS NOT NULL")).fetchall()))
    columns = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    got = sorted(str(tuple(r)) for r in license_scan(docs.filter("doc_id IS NOT NULL AND doc_id != 2007")).select(columns).collect())
    assert got == want
    rows = {r.doc_id: r for r in license_scan(docs).collect()}
    assert rows[2010].labels == "apache,apache-2.0" and rows[2012].labels == "gpl,gpl-3"
    assert (rows[2011].n_base, rows[2011].first_word, rows[2011].last_word, rows[2011].labels) == (2, 1, 7, "mit")
    assert license_scan(none).count() == 0 and license_scan(docs).count() == len(corpus)


def test_a_row_in_a_third_of_the_table_is_one_document(spark, monkeypatch):
    from blockloom.llm import common, line_dedup as module

    monkeypatch.setattr(module, "HELD", 40)
    monkeypatch.setattr(common, "HOT_LEAST", 100)
    text = "\n".join(["often"] * 30 + ["once"] + [f"few {i}" for i in range(40)])
    rows = [(7, text)] * 900 + [(None, f"often\nnull {i}\nnameless") for i in range(12)] + [(i, f"often\nown {i}") for i in range(100, 700)]
    rows += [(50, f"one id\nversion {i}") for i in range(400)] + [(60 + i % 9, f"nine ids\nversion {i}") for i in range(300)] + [(80 + i % 11, f"eleven ids\nversion {i}") for i in range(300)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(9)
    who = defaultdict(set)
    for i, t in rows:
        for line in t.split("\n"):
            who[line].add(i if i is not None else t)
    want = Counter((i, len(t.split("\n")), sum(len(who[x]) >= 10 for x in t.split("\n"))) for i, t in rows)
    got = Counter((r.doc_id, r.n_lines, r.n_dropped) for r in apply_bitmaps(frame, line_dedup(frame)).collect())
    assert got == want and len(who["one id"]) == 1 and len(who["nine ids"]) == 9 and len(who["nameless"]) == 12


def test_texts_of_one_id_are_one_document(spark):
    rows = [(1, f"shared\nversion {i}") for i in range(30)] + [(2, "shared")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.n_dropped for r in apply_bitmaps(frame, line_dedup(frame)).collect()} == {0}


def test_one_row_of_rows_with_equal_id_and_text(spark):
    """Whichever stays, it is one of them, whole; reruns agree."""
    rows = [(1, "same text here now ok", "a", 5), (1, "same text here now ok", "b", 6), (1, "same text here now ok", None, 7), (2, "another one of five words", "c", 8), (2, "another one of five words", "c", 8), (3, "a third text of five words", "d", 9)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, same string, rid int")
    kept = simhash.one_of_each(frame)
    assert kept.schema == frame.schema
    found = sorted(map(tuple, kept.collect()))
    assert [r[0] for r in found] == [1, 2, 3] and set(found) <= set(rows)
    assert found == sorted(map(tuple, simhash.one_of_each(frame.repartition(3)).collect()))


def test_groups_in_salted_parts(spark, monkeypatch):
    from blockloom.llm import common, graph

    monkeypatch.setattr(common, "HOT_LEAST", 20)
    monkeypatch.setattr(common, "HOT_PARTS", 10)
    monkeypatch.setattr(graph, "HOT_LEAST", 20)
    rows = [(i, "copies of one text") for i in range(400)] + [(1000 + i, f"text {i} of its own with words {i * 7} and {i * 13}") for i in range(100)] + [(2000, None)] * 90
    got = {r.doc_id: r.component_id for r in simhash.simhash_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i] == 0 for i in range(400)) and got[2000] == 2000 and len(got) == 501
    edges = spark.createDataFrame([(0, i) for i in range(1, 500)] + [(i, i + 1) for i in range(600, 700)], "u long, v long")
    assert {r.node: r.root for r in connected_components(edges).collect()} == {i: 0 for i in range(500)} | {i: 600 for i in range(600, 701)}


def test_licences_by_any_of_their_rare_words(spark):
    from blockloom.llm import license_scan as module

    notices = {label: notice for label, notice, _ in module.TEMPLATES}
    gone = notices["bsd-endorse"].replace("neither", "not").replace("contributors", "authors")
    several = "... ".join(notices.values())
    rows = [(1, "x " + gone.upper() + " y"), (2, several), (3, "endorse or promote products derived from this software"), (4, "Ä MIT License É"), (5, ("w " * 200 + notices["zlib"] + " ") * 300), (6, None), (7, "permission hereby granted " * 20_000)]
    documents = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r for r in license_scan(documents).collect()}
    assert found[1].labels == "bsd-endorse" and 0.8 <= found[1].score < 1
    assert set(notices) <= set(found[2].labels.split(",")) and found[2].score == 1
    assert found[3].labels == "" and found[4].labels == "mit" and found[5].labels == "zlib" and found[6].n_words == 0 and found[7].n_words == 60_000
    documents = documents.filter("length(text) < 10000").toPandas()  # noqa: F841
    columns = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    assert sorted(map(str, duckdb.sql(oracle_sql()).fetchall())) == sorted(str(tuple(found[i][c] for c in columns)) for i in (1, 2, 3, 4))
