import random

import numpy as np
import pytest
import xxhash

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from blockloom.llm import jaccard, simhash  # noqa: E402


def sets_of(sizes, seed=3):
    rng = np.random.default_rng(seed)
    return [np.unique(rng.integers(0, 1 << 64, n, np.uint64)) for n in sizes]


def test_a_wide_bit_is_set_in_over_half_of_the_hashes():
    sets = sets_of([1, 2, 3, 254, 255, 256, 511, 700])
    for one, found in zip(sets, simhash.wide_simhash(sets), strict=True):
        words = simhash.wide_simhash([one[i : i + 1] for i in range(len(one))])  # of one hash: its own mixed bits
        bits = np.unpackbits(words.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        assert np.array_equal(np.unpackbits(found.view(np.uint8), bitorder="little"), bits * 2 > len(one))
        assert len(one) > 1 or 400 < bits.sum() < 624


@pytest.mark.parametrize("n", [300, 5000])
def test_labels_equal_chains_of_near_prints(n):
    rng = np.random.default_rng(n)
    prints = rng.integers(0, 1 << 64, (n, 3), np.uint64)
    for i in range(n // 3, n):  # near copies, in chains and around hubs
        prints[i] = prints[i - 1 if i % 3 else n // 4]
        for b in rng.choice(192, 30, replace=False):
            prints[i, b // 64] ^= np.uint64(1 << int(b % 64))
    group = list(range(n))
    near = [(i, int(j)) for i in range(n) for j in np.flatnonzero(np.bitwise_count(prints[i] ^ prints[:i]).sum(axis=1) <= 56)]

    def root(i):
        while group[i] != i:
            group[i] = group[group[i]]
            i = group[i]
        return i

    for i, j in near:
        group[root(i)] = root(j)
    label = simhash._labels(prints, 56)
    pairs = {(root(i), int(label[i])) for i in range(n)}
    assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs}) < n


@pytest.mark.parametrize("bucket", [8, 1000])
def test_the_stage_proposes_by_simhash_what_brute_force_finds(spark, bucket):
    """Texts of every size; pairs from 0.8 on are in one cluster of near fingerprints, as are the links of the stage."""
    rnd = random.Random(4)
    words = [f"{a}{b}{c}" for a in "kbdgmnprst" for b in "aeiou" for c in "lnrst"]
    texts = []
    for n in [9, 12, 20, 40, 80, 200] * 40:
        base = [rnd.choice(words) for _ in range(n)]
        for edits in (0, 1, 1, 2, 3):
            parts = list(base)
            for at in rnd.sample(range(n), min(edits, n // 25)):
                parts[at] = "new" + rnd.choice(words)
            texts.append(" ".join(parts + ["end"] * (edits == 1 and n < 25)))
    sets = [jaccard.shingle_set(t.encode()) for t in texts]
    sids = [xxhash.xxh64_intdigest(s.tobytes(), simhash.SEED) - (1 << 63) for s in sets]
    prints = simhash.wide_simhash(sets)
    nodes = spark.createDataFrame(list({s: (s, bytearray(p.tobytes())) for s, p in zip(sids, prints, strict=True)}.values()), "sid long, fp binary")
    together = {}
    for r in simhash.near_clusters(nodes, 0.8, bucket).collect():
        together.setdefault(r.key, set()).add(r.sid)
        assert r.least <= r.sid and r.n >= 2
    pairs = set()
    for members in together.values():
        pairs |= {(a, b) for a in members for b in members}
    wanted, group = set(), list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a - a % 5, a):  # others have random words, no shingle in common
            both = len(np.intersect1d(sets[a], sets[b]))
            if 5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both):
                wanted.add((sids[a], sids[b]))
                low, high = sorted((group[a], group[b]))
                group = [low if g == high else g for g in group]
    wanted = {p for p in wanted if p[0] != p[1]}
    assert len(wanted) > 150 and len(wanted - pairs) <= 0.002 * len(wanted)
    frame = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    rows = jaccard.jaccard_groups(frame, bucket=bucket).collect()
    assert len({(group[r.doc_id], r.root) for r in rows}) == len(set(group)) == len({r.root for r in rows})
    assert sorted(r.doc_id for r in corpus_pipeline.dedup_near(spark, frame, "").collect()) == sorted(set(group))
