import zlib
from collections import defaultdict

import numpy as np
import pytest

from blockloom.llm import packing
from blockloom.llm.queries import tokenizer_json


@pytest.fixture(scope="module")
def json():
    return tokenizer_json()


@pytest.mark.parametrize("near", [None, "source"])
def test_pieces_rebuild_every_document(docs, corpus, json, near):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(json)
    want = defaultdict(list)
    for doc_id, text, *_ in corpus:
        want[doc_id].append(tokenizer.encode(text or "", add_special_tokens=False).ids + [2])
    pieces = packing.pack(docs, json, window=256, shard_bytes=20_000, near_col=near).collect()
    parts, sequences = defaultdict(list), defaultdict(list)
    for p in pieces:
        ids = np.frombuffer(p.ids, "<u4")
        assert len(ids) == p.length > 0 and zlib.crc32(bytes(p.ids)) == p.ids_crc32
        parts[p.doc_id].append((p.start, ids.tolist(), p.doc_tokens))
        sequences[p.sequence_id].append((p.offset, p.length))
    for doc_id, texts in want.items():
        got = sorted(parts[doc_id])
        if len(texts) == 1:
            assert sum((x for _, x, _ in got), []) == texts[0] and all(n == len(texts[0]) for *_, n in got)
        else:
            assert sum(len(x) for _, x, _ in got) == sum(map(len, texts))
    for spans in sequences.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at == 256 or (at < 256 and at & (at - 1) == 0)


def test_words_encode_as_whole_texts(json):
    from tokenizers import Tokenizer

    odd = ["A  b\tc\x0bd\x1ce\x85f\xa0g", "don't DON'T it's 12,345 é́ É İstanbul ΣΑΣ ς", "<|endoftext|> a<|endoftext|>b <|ENDOFTEXT|>", "́ x", "你好。 word—dash…", "", " "]
    enc, plain = packing.Encoder(json), Tokenizer.from_str(json)
    for _ in range(2):
        for text, ids in zip(odd, enc.encode([t.encode() for t in odd]), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids, text


def test_scores_equal_brute_force_bm25():
    rnd = np.random.default_rng(5)
    docs = [rnd.integers(0, 40, rnd.integers(1, 60)) for _ in range(30)]
    lens = np.array([len(d) for d in docs])
    idf = rnd.random(40)
    index = packing.Index(np.concatenate(docs).astype("<u4"), lens, idf, lens.mean())
    for seed in range(30):
        got = index.scores(seed)
        for d, doc in enumerate(docs):
            want = 0.0
            for t in set(docs[seed].tolist()):
                tf = int((doc == t).sum())
                want += idf[t] * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(doc) / lens.mean()))
            assert abs(got[d] - want) < 1e-9


def test_neighbours_share_windows():
    topics = [np.arange(10) + 10 * k for k in range(5)]
    rnd = np.random.default_rng(1)
    docs = [rnd.choice(topics[i % 5], 32) for i in range(40)]
    lens = np.full(40, 32)
    pieces = packing.fill(packing.Index(np.concatenate(docs).astype("<u4"), lens, np.ones(50), 32.0), lens, 256)
    together = defaultdict(set)
    for doc, *_, seq, _ in pieces:
        together[seq].add(doc % 5)
    assert all(len(x) == 1 for x in together.values())


def test_empty_table_and_odd_sizes(none, spark, json):
    assert packing.pack(none, json).count() == 0
    rows = packing.pack(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string"), json).collect()
    assert sorted((r.doc_id, r.start, r.length, r.doc_tokens) for r in rows) == [(1, 0, 1, 1), (2, 0, 1, 1)]
