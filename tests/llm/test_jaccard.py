import random

from blockloom.llm import jaccard

corpus_words = [f"{a}{b}" for a in ("ka", "lo", "mi", "re", "tu", "zo") for b in ("na", "su", "pe", "ti", "ga")]


def shingles(text):
    parts = text.encode().lower().split()
    return {b" ".join(parts[i : i + 5]) for i in range(max(1, len(parts) - 4))}


def components(sets):
    """The least member that links of 0.8 or more reach, by all pairs."""
    group = list(range(len(sets)))
    for a in range(len(sets)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if 5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both) and group[a] != group[b]:
                low, high = sorted((group[a], group[b]))
                group = [low if g == high else g for g in group]
    return group


def edited(rnd, text, n):
    parts = text.split()
    for at in rnd.sample(range(len(parts)), n):
        parts[at] = rnd.choice(corpus_words) + "x"
    return " ".join(parts)


def test_copies_of_five_words_in_0_8_to_1_are_found(spark):
    import corpus_pipeline

    rnd = random.Random(5)
    texts = []
    for _ in range(60):
        base = " ".join(rnd.choice(corpus_words) for _ in range(200))
        texts += [base, *(edited(rnd, base, n) for n in (1, 2, 3, 4, 5, 8))]
    hub = " ".join(rnd.choice(corpus_words) for _ in range(200))
    texts += [edited(rnd, hub, 3) for _ in range(150)]  # one group, many of its pairs below 0.8
    passage = " ".join(rnd.choice(corpus_words) for _ in range(80))
    texts += [passage + " " + " ".join(rnd.choice(corpus_words) for _ in range(40)) for _ in range(60)]  # alike, but not enough
    frame = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = sorted(r.doc_id for r in corpus_pipeline.dedup_near(spark, frame, "").collect())
    want = sorted(set(components([shingles(t) for t in texts])))
    assert kept == want and len(want) < len(texts) - 150


def test_edges_of_the_corpus(docs, none, corpus):
    assert jaccard.one_of_each(none).count() == 0
    assert jaccard.jaccard_groups(docs).count() == len(corpus)
