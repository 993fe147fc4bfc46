import re
from collections import Counter, defaultdict

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from blockloom.llm.simhash import simhash  # noqa: E402


def key(line):
    return re.sub(r"^[\x20\x09-\x0d]+|[\x20\x09-\x0d]+$", "", line).translate({c: c + 32 for c in range(65, 91)})


@pytest.fixture(scope="module")
def stages(spark, docs):
    """What each stage returns, over the small corpus."""
    out, now = [], docs
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, "").cache()
        out.append((name, now, now.collect()))
    return out


def test_language_stage_drops_only_texts_without_letters(stages, corpus):
    kept = stages[0][2]
    want = Counter((i, t) for i, t, *_ in corpus if t and re.search(r"[^\W\d_]", t))
    assert Counter((r.doc_id, r.text) for r in kept) == want
    assert stages[0][1].columns == corpus_pipeline.COLUMNS and all(r.lang == "en" for r in kept)


def test_lines_equal_brute_force(stages):
    before, after = stages[0][2], stages[1][2]
    where = defaultdict(set)
    for r in before:
        for line in r.text.split("\n"):
            where[key(line)].add((r.doc_id, r.text))
    drop = {k for k, v in where.items() if k and len(v) >= 10}
    want = Counter((r.doc_id, "\n".join(x for x in r.text.split("\n") if key(x) not in drop)) for r in before)
    assert drop and Counter((r.doc_id, r.text) for r in after) == want
    assert all(r.n_chars == len(r.text) for r in after)


def test_near_copies_equal_brute_force(stages):
    before, after = stages[1][2], stages[2][2]
    prints = [(r.doc_id, r.text, int.from_bytes(simhash(r.text.encode()), "big")) for r in before]
    group = list(range(len(prints)))
    changed = True
    while changed:
        changed = False
        for a in range(len(prints)):
            for b in range(a):
                if (prints[a][2] ^ prints[b][2]).bit_count() <= 2 and group[a] != group[b]:
                    group[a] = group[b] = min(group[a], group[b])
                    changed = True
    members = defaultdict(list)
    for g, p in zip(group, prints, strict=True):
        members[g].append(p[0])
    want = sorted(min((i for i in ids if i is not None), default=-1) for ids in members.values())
    assert sorted(-1 if r.doc_id is None else r.doc_id for r in after) == want
    assert len(after) < len(before)


def water(sizes, share=1.5, most=2):
    """Targets by resharing until no source is above its bound."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    target, free, left = {}, set(names), share * sum(sizes.values())
    while free:
        over = [s for s in free if left * weight[s] / sum(weight[x] for x in free) > most * sizes[s]]
        if not over:
            return target | {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        for s in over:
            target[s] = most * sizes[s]
            free.discard(s)
        left = share * sum(sizes.values()) - sum(target.values())
    return target


def test_each_document_gets_its_rate_rounded_down_or_up(stages):
    before, after = stages[2][2], stages[3][2]
    sizes = Counter()
    for r in before:
        sizes[r.source] += len(r.text.split())
    targets = water(sizes)
    copies = Counter((r.doc_id, r.text) for r in after)
    for r in before:
        rate = targets[r.source] / sizes[r.source]
        assert copies[r.doc_id, r.text] in {int(rate + 1e-9), min(2, int(rate) + 1)}
    assert set(copies) <= {(r.doc_id, r.text) for r in before}


def test_packing_takes_all_copies(stages):
    before, pieces = stages[3][2], stages[4][2]
    starts = Counter(p.doc_id for p in pieces if p.start == 0)
    assert starts == Counter(r.doc_id for r in before)
    sizes = defaultdict(int)
    for p in pieces:
        sizes[p.sequence_id] += p.length
    assert all(n == 4096 or n & (n - 1) == 0 for n in sizes.values())


def test_an_empty_table_goes_through(spark, none):
    now = none
    for _, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, "")
        assert now.count() == 0
