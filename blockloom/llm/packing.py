"""Packing by lexical retrieval: a sharded BM25 index hands each seed its unused neighbours.

Documents are dealt by a hash and cut into shards of bounded size. A shard tokenises its documents
once and is written as one row. BM25 weights use document frequencies and lengths over all documents; as
terms are token ids, those statistics are bounded by the vocabulary. Each shard then builds its
inverted index and fills windows: the seed (the rest of a cut document, or the next unused one)
is followed by its unused neighbours, best score first, until the window is full. The last
window of a shard is cut into powers of two, so nothing is padded.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockloom.llm.common import lean, materialize, process_cache, row_key

#: Bytes of text in a shard; it is cut where it reaches them.
SHARD_BYTES = 2_000_000
WINDOW, END_ID = 4096, 2
K1, B = 1.2, 0.75
#: Words that a worker remembers the ids of.
CACHED_WORDS = 350_000
_MARK = b"<|"
#: Words that decide whether a tokenizer's model can be asked directly.
_PROBES = ("the", "retrieval", "zzxqj", "a", "thanontioner", "été", "ciónñ", "größe")


def _byte_letters() -> dict[int, str]:
    """The printable character that byte-level models use for each byte: itself, or the next free one from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


#: What may stand after a plain word and is a piece of its own; no apostrophe, which can begin a contraction.
_AFTER = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


class _Words(dict):
    """Word to ids; a word that is missing is encoded, remembered, and listed in ``fresh``."""

    def __init__(self, encode):
        super().__init__()
        self.encode, self.fresh = encode, []

    def __missing__(self, word: bytes) -> bytes:
        ids = self[word] = self.encode(word)
        self.fresh.append(word)
        return ids


class Encoder:
    """Token ids of whole texts. White space separates tokens, so words are encoded once and remembered.

    Plain words (letters of the Latin blocks, perhaps with punctuation after) skip the tokenizer's
    normalisation and go to its merges directly, if probes show that this gives the same ids.
    """

    def __init__(self, json: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the executor's cores run tasks
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(json)
        self.tokenize = self.tokenizer.model.tokenize
        self.tokenizer.model._resize_cache(0)  # words are remembered here
        self.letters = {b: c for b, c in _byte_letters().items() if chr(b) != c}
        self.ends: dict[bytes, bytes] = {}
        self.words = _Words(self._word)
        self.direct = all(self._merged(w) == self._slow(w.encode()) and all(self._merged(w) + self._slow(end) == self._slow(w.encode() + end) for end in (b".", b",", b"***", b").")) for w in _PROBES)

    def _slow(self, word: bytes) -> bytes:
        return array("I", self.tokenizer.encode(word.decode(), add_special_tokens=False).ids).tobytes()

    def _merged(self, word: str) -> bytes:
        spelled = word if word.isascii() else word.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.tokenize(spelled)]).tobytes()

    def _word(self, word: bytes) -> bytes:
        if not self.direct:
            return self._slow(word)
        stem = word.rstrip(_AFTER)
        if stem.isalpha() and stem.islower():
            if len(stem) == len(word):
                return array("I", [t.id for t in self.tokenize(word.decode())]).tobytes()
        else:
            text = stem.decode().lower()
            if not text.isalpha() or max(text) >= "\u0180":
                return self._slow(word)
            if len(stem) == len(word):
                return self._merged(text)
        end = word[len(stem) :]
        if end not in self.ends:
            self.ends[end] = self._slow(end)
        return self.words[stem] + self.ends[end]

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        look, words = self.words.__getitem__, self.words
        # ASCII case goes anyway, except inside the marks of special tokens
        out = [b"".join(map(look, (t if _MARK in t else t.lower()).split())) for t in texts]
        if len(words) > CACHED_WORDS:  # full: what was new isn't remembered
            for word in words.fresh:
                del words[word]
        words.fresh.clear()
        if len(self.ends) > 10_000:
            self.ends.clear()
        return out


def encoder(json: str) -> Encoder:
    cache = process_cache()
    key = ("encoder", zlib.crc32(json.encode()), len(json))
    if key not in cache:
        cache[key] = Encoder(json)
    return cache[key]


def doc_terms(tokens: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, term, frequency) of each distinct term of each document, in order."""
    bits = max(1, int(tokens.max(initial=0)).bit_length())
    small = len(lens) << bits < 1 << 32
    kind = np.uint32 if small else np.uint64
    pairs, tf = np.unique(np.repeat(np.arange(len(lens), dtype=kind) << kind(bits), lens) | tokens.astype(kind, copy=False), return_counts=True)
    return (pairs >> kind(bits)).astype(np.int64), (pairs & kind((1 << bits) - 1)).astype(np.int64), tf


_SHARD = "first_seq long, doc_ids array<long>, n_ids array<int>, ids binary, df_ids binary, df_counts binary"


def _tokenize(json: str, end_id: int, window: int, most_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, end = encoder(json), np.array([end_id], "<u4").tobytes()
        # sequences are numbered from the partition's number; the shards are written once, and so are the numbers
        seq, ids, texts, size = TaskContext.get().partitionId() << 32, [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal seq, ids, texts, size
            blobs = [b + end for b in enc.encode(texts)]
            lens = np.array([len(b) // 4 for b in blobs], np.int32)
            tokens = np.frombuffer(b"".join(blobs), "<u4")
            _, terms, _ = doc_terms(tokens, lens)
            counts = np.bincount(terms)
            terms = np.flatnonzero(counts)
            counts = counts[terms]
            narrow = tokens.astype("<u2") if not len(tokens) or tokens.max() < 1 << 16 else tokens
            row = pa.RecordBatch.from_arrays(
                [
                    pa.array([seq], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([lens], pa.list_(pa.int32())),
                    pa.array([narrow.tobytes()], pa.binary()), pa.array([terms.astype("<u4").tobytes()], pa.binary()), pa.array([counts.astype("<u4").tobytes()], pa.binary()),
                ],
                names=["first_seq", "doc_ids", "n_ids", "ids", "df_ids", "df_counts"],
            )
            seq += len(tokens) // window + 1 + window.bit_length()
            ids, texts, size = [], [], 0
            return row

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids.append(doc_id)
                texts.append(text or b"")
                size += len(text or b"")
                if size >= most_bytes:
                    yield flush()
        if ids:
            yield flush()

    return run


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(1 << 16, np.int64)
    for batch in batches:
        for terms, counts in zip(batch.column("df_ids").to_pylist(), batch.column("df_counts").to_pylist(), strict=True):
            terms, counts = np.frombuffer(terms, "<u4"), np.frombuffer(counts, "<u4")
            if len(terms) and terms[-1] >= len(total):
                total = np.append(total, np.zeros(int(terms[-1]) + 1 - len(total), np.int64))
            total[terms] += counts
    some = np.flatnonzero(total)
    if len(some):
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int64)), pa.array(total[some])], names=["term", "df"])


class Index:
    """BM25 over one shard's documents."""

    def __init__(self, tokens: np.ndarray, lens: np.ndarray, idf: np.ndarray, mean_len: float):
        n = len(lens)
        doc, term, tf = doc_terms(tokens, lens)
        weight = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * lens[doc] / mean_len))
        self.n, self.terms = n, term
        self.of_doc = np.searchsorted(doc, np.arange(n + 1))
        order = np.argsort(term, kind="stable")
        self.docs, self.weights = doc[order], weight[order]
        known, first = np.unique(term[order], return_index=True)
        self.first = np.zeros(len(idf) + 1, np.int64)
        self.count = np.zeros(len(idf) + 1, np.int64)
        self.first[known] = first
        self.count[known] = np.diff(np.append(first, len(order)))

    def scores(self, seed: int) -> np.ndarray:
        """BM25 of every document for the distinct terms of ``seed``."""
        query = self.terms[self.of_doc[seed] : self.of_doc[seed + 1]]
        counts = self.count[query]
        ends = np.cumsum(counts)
        at = np.arange(ends[-1]) + np.repeat(self.first[query] - (ends - counts), counts)
        return np.bincount(self.docs[at], self.weights[at], minlength=self.n)


def fill(index: Index, lens: np.ndarray, window: int) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) of a shard; only its last window is short."""
    pieces: list[tuple[int, int, int, int, int]] = []
    used = np.zeros(len(lens), bool)
    done = np.zeros(len(lens), np.int64)
    open_doc, next_doc, seq, total = -1, 0, 0, int(lens.sum())
    while total:
        room, offset, now = window, 0, []
        if open_doc < 0:
            while used[next_doc]:
                next_doc += 1
            open_doc = next_doc
            used[open_doc] = True
        seed, queue = open_doc, None
        while room and total:
            if open_doc < 0:
                if queue is None:
                    score = np.where(used, -1.0, index.scores(seed))
                    # unused documents without a common term come last, in order
                    queue = iter(np.argsort(-score, kind="stable")[: int((~used).sum())].tolist())
                open_doc = next(queue)
                used[open_doc] = True
            take = min(room, int(lens[open_doc] - done[open_doc]))
            now.append((open_doc, int(done[open_doc]), take, seq, offset))
            done[open_doc] += take
            offset, room, total = offset + take, room - take, total - take
            if done[open_doc] == lens[open_doc]:
                open_doc = -1
        if room:
            now = _powers(now, window - room, seq)
            seq = now[-1][3]
        pieces += now
        seq += 1
    return pieces


def _powers(pieces: list[tuple[int, int, int, int, int]], n: int, seq: int) -> list[tuple[int, int, int, int, int]]:
    """The pieces of a window of ``n`` ids, cut anew into sequences whose lengths are powers of two."""
    sizes = [1 << k for k in reversed(range(n.bit_length())) if n >> k & 1]
    out, at, offset = [], 0, 0
    for doc, start, length, _, _ in pieces:
        while length:
            take = min(length, sizes[at] - offset)
            out.append((doc, start, take, seq + at, offset))
            start, length, offset = start + take, length - take, offset + take
            if offset == sizes[at]:
                at, offset = at + 1, 0
    return out


def _pack(idf: np.ndarray, mean_len: float, window: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, doc_ids, lens, blob in zip(*(batch.column(c).to_pylist() for c in ("first_seq", "doc_ids", "n_ids", "ids")), strict=True):
                lens = np.array(lens, np.int64)
                wide = len(blob) == 4 * int(lens.sum())
                tokens = np.frombuffer(blob, "<u4" if wide else "<u2").astype("<u4")
                begins = np.append(0, np.cumsum(lens))
                pieces = fill(Index(tokens, lens, idf, mean_len), lens, window)
                doc, start, length, seq, offset = (np.array(x, np.int64) for x in zip(*pieces, strict=True))
                raw = [tokens[begins[d] + s : begins[d] + s + n].tobytes() for d, s, n, _, _ in pieces]
                cols = [
                    pa.array([doc_ids[d] for d in doc.tolist()], pa.int64()), pa.array(start), pa.array(length), pa.array([zlib.crc32(r) for r in raw], pa.int64()),
                    pa.array(lens[doc]), pa.array(first + seq), pa.array(offset),
                ]
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
                if with_ids:
                    cols.append(pa.array(raw, pa.binary()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return run


def pack(docs: DataFrame, tokenizer_json: str, window: int = WINDOW, end_id: int = END_ID, shard_bytes: int = SHARD_BYTES, with_ids: bool = True, id_col: str = "doc_id", text_col: str = "text", near_col: str | None = None) -> DataFrame:
    """Pieces: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids, unsigned 32-bit little-endian).

    ``tokenizer_json`` is the content of a tokenizer file whose tokens don't cross ASCII white space.
    Each document is its ids and ``end_id``; each id lies in exactly one piece. Sequences hold
    ``window`` ids or a power of two. Documents alike in ``near_col`` (say, their language) go to the same shards of
    a task, as neighbours are sought within a shard. A null or empty text is ``end_id`` alone. Repeated rows are
    packed each for itself; a null doc_id stays null. An empty table gives no pieces.
    """
    near = F.lit(None).cast("string") if near_col is None else docs[near_col].cast("string")
    own = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"), near.alias("near")).withColumn("rid", row_key())
    dealt = own.select("near", "rid", "doc_id", F.col("text").cast("binary").alias("text")).repartition("rid").sortWithinPartitions("near", "rid", "doc_id")
    shards = materialize(dealt.select("doc_id", "text").mapInArrow(lean(_tokenize(tokenizer_json, end_id, window, shard_bytes), 1000, keep=True), _SHARD), "shards")
    sizes = shards.agg(F.sum(F.size("n_ids")), F.sum(F.aggregate("n_ids", F.lit(0).cast("long"), lambda s, x: s + x))).first()
    n_docs, n_tokens = sizes[0] or 0, sizes[1] or 0
    # at most one row for each token of the vocabulary
    df = shards.select("df_ids", "df_counts").mapInArrow(_frequencies, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect()
    idf = np.zeros(max((r.term for r in df), default=0) + 1)
    for r in df:
        idf[r.term] = np.log1p((n_docs - r.df + 0.5) / (r.df + 0.5))
    kinds = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids binary" * with_ids
    return shards.select("first_seq", "doc_ids", "n_ids", "ids").mapInArrow(lean(_pack(idf, max(1.0, n_tokens / max(1, n_docs)), window, with_ids), 1), kinds)
