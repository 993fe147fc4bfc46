"""Language ID by multilingual mixture inference.

Each language has a model of character trigrams (UTF-8 bytes, hashed to a fixed table). A document is a
mixture: each word comes from one of its languages, with the word's trigram likelihood. Expectation
maximisation estimates the proportions; the language set is grown by the language of the next greatest share as long as
that raises the penalised likelihood (each language beyond the first costs ``penalty`` times the logarithm of the number of
words). Documents are solved many at a time, as segments of one array; how many follows from the number of languages, and a
document too long for that is read anew in each round, so memory is bounded for any text and number of languages.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blockloom.llm.common import broadcast_if_small, lean

BUCKETS = 1 << 16
#: At most so many labelled documents (in expectation), dealt evenly over the languages, fit the models.
TRAIN_ROWS = 20_000
SMOOTHING = 0.1
#: Bytes of text, times languages, that are solved together.
CHUNK = 8_000_000
#: A document of so many times as many bytes is read anew in each round.
HELD = 4
#: Languages whose models are looked up at a time.
LANGUAGES_AT_ONCE = 16
UNKNOWN = "und"

_TABLE = bytes(b if b >= 0x80 or chr(b).isalpha() else 0x20 for b in range(256))


def has_letter(text: str | None) -> bool:
    """Whether any character is a letter (of the Unicode categories L; numbers such as one half are none)."""
    return text is not None and any(map(str.isalpha, text))


class _Kept(dict):
    """Code point to itself for letters and the marks that belong to them, else to a space."""

    def __missing__(self, point: int) -> int:
        import unicodedata

        self[point] = point if unicodedata.category(chr(point))[0] in "LM" else 0x20
        return self[point]


_KEPT = _Kept()


def letters(text: str) -> bytes:
    """Lower-cased UTF-8 with a space for each character that is no letter, and spaces at both ends."""
    low = text.lower()
    data = low.encode().translate(_TABLE) if low.isascii() else low.translate(_KEPT).encode()
    return b" " + data + b" "


def grams(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Table rows of the trigrams around each letter byte; where words start among them; where in ``data``."""
    b = np.frombuffer(data, np.uint8)
    inner = b[1:-1] != 32
    code = (b[:-2].astype(np.uint32) << 16 | b[1:-1].astype(np.uint32) << 8 | b[2:])[inner]
    rows = (code * np.uint32(2654435761)) >> np.uint32(16)
    starts = (b[:-2] == 32)[inner]
    return rows, np.flatnonzero(starts), np.flatnonzero(inner)[starts] + 1


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            rows, _, _ = grams(letters(text))
            sums.setdefault(lang, np.zeros(BUCKETS, np.int64))
            sums[lang] += np.bincount(rows, minlength=BUCKETS)
    for lang, total in sums.items():
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), pa.array(some), pa.array(total[some])], names=["lang", "bucket", "n"])


def unit(key: Column) -> Column:
    """A number in [0, 1) of a 64-bit hash."""
    return (F.shiftrightunsigned(key, 11) / F.lit(float(1 << 53))).cast("double")


def fit(labelled: DataFrame, train_rows: int = TRAIN_ROWS) -> tuple[list[str], np.ndarray]:
    """(doc_id, text, lang), all non-null, to the languages and their log-probabilities (BUCKETS x languages).

    Every label is learned; a model takes 256 KiB on the driver and in each worker. The sample takes each language's
    documents at a rate that gives it an equal part of ``train_rows`` in expectation, so its size doesn't grow with the
    table; repeated rows count once. The driver receives one row a language, of bounded size.
    """
    totals = labelled.groupBy("lang").agg(F.count("*").alias("n"))
    n_langs = totals.count()
    if not n_langs:
        return [], np.zeros((BUCKETS, 0), np.float32)
    rates = broadcast_if_small(totals.select(F.col("lang").alias("r_lang"), F.least(F.lit(1.0), F.lit(train_rows / n_langs) / F.col("n")).alias("rate")))
    keyed = labelled.withColumn("key", F.xxhash64("doc_id", "text", F.lit("lang")))
    # texts are not joined with the rates: what is drawn is a bounded sample of keys
    drawn = keyed.select("key", "lang").join(rates, keyed["lang"] == rates["r_lang"]).filter(unit(F.col("key")) < F.col("rate")).select("key").distinct()
    sample = keyed.join(F.broadcast(drawn), "key", "left_semi").groupBy("key", "lang").agg(F.first("text").alias("text")).repartition(8, "key")
    counted = sample.select("lang", "text").mapInArrow(lean(_counts, 1000), "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    # one row a language, of at most BUCKETS pairs
    sums: dict[str, np.ndarray] = {}
    for r in counted.groupBy("lang").agg(F.collect_list("bucket").alias("at"), F.collect_list("n").alias("n")).toLocalIterator():
        sums[r.lang] = np.zeros(BUCKETS, np.int64)
        sums[r.lang][r.at] = r.n
    langs = sorted(sums)
    if not langs:
        return [], np.zeros((BUCKETS, 0), np.float32)
    table = np.stack([sums[lang] for lang in langs], axis=1) + SMOOTHING
    return langs, np.log(table / table.sum(axis=0)).astype(np.float32)


def _em(words: np.ndarray, doc: np.ndarray, starts: np.ndarray, allowed: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Proportions and log-likelihoods of documents whose languages are limited to ``allowed``.

    words: likelihoods (word x language), scaled by each word's greatest; doc: document of each word,
    in order; starts: first word of each document.
    """
    share = allowed / allowed.sum(axis=1, keepdims=True)
    sizes = np.diff(np.append(starts, len(words)))[:, None]
    for _ in range(rounds):
        joint = words * share[doc]
        joint /= np.maximum(joint.sum(axis=1, keepdims=True), 1e-30)
        share = np.add.reduceat(joint, starts, axis=0) / sizes
    total = np.maximum((words * share[doc]).sum(axis=1), 1e-30)
    return share, np.add.reduceat(np.log(total, dtype=np.float64), starts)


def _scores(data: bytes, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-likelihood of each word (word x language), a few languages at a time, and where the words start."""
    rows, word, place = grams(data)
    if not len(word):
        return np.zeros((0, table.shape[1]), np.float32), place
    if table.shape[1] <= LANGUAGES_AT_ONCE:
        return np.add.reduceat(table[rows], word, axis=0), place
    parts = [np.add.reduceat(table[:, a : a + LANGUAGES_AT_ONCE][rows], word, axis=0) for a in range(0, table.shape[1], LANGUAGES_AT_ONCE)]
    return np.concatenate(parts, axis=1), place


def _pieces(data: bytes, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of at most about ``most`` bytes that begin and end at a space; a longer word makes a longer range."""
    at = 0
    while at < len(data) - 2:
        end = len(data) if at + most >= len(data) else data.rfind(b" ", at, at + most)
        if end <= at:
            end = data.find(b" ", at + most)
            end = len(data) if end < 0 else end
        yield at, min(end + 1, len(data))
        at = end


def _long(data: bytes, table: np.ndarray, penalty: float, rounds: int, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """:func:`solve` for one document of any length: each round reads it anew, a piece at a time."""

    def blocks() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for a, b in _pieces(data, most):
            score, _ = _scores(data[a:b], table)
            if len(score):
                top = score.max(axis=1, keepdims=True)
                yield np.exp(np.maximum(score - top, -60)), (score - top).astype(np.float64).sum(axis=0)

    def em(allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        share = allowed / allowed.sum(axis=1, keepdims=True)
        for last in [False] * rounds + [True]:
            total, n, likely = np.zeros(table.shape[1]), 0, 0.0
            for words, _ in blocks():
                joint = words * share[0].astype(words.dtype)
                mass = np.maximum(joint.sum(axis=1, keepdims=True), 1e-30)
                total, n, likely = total + (joint / mass).sum(axis=0, dtype=np.float64), n + len(words), likely + np.log(mass, dtype=np.float64).sum()
            share = share if last or not n else (total / n)[None, :]
        return share, np.array([likely])

    one, n_words = np.zeros(table.shape[1]), 0
    for words, sums in blocks():
        one, n_words = one + sums, n_words + len(words)
    if not n_words:
        none = np.zeros((1, table.shape[1]))
        return none, none.astype(bool), none
    return _grow(one[None, :], np.array([n_words]), lambda allowed, _: em(allowed), penalty)


def _grow(one: np.ndarray, sizes: np.ndarray, em: Callable, penalty: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Proportions, language sets, and proportions when all languages are allowed.

    one: likelihood of each document in each language alone; sizes: words of each; em: solves the given documents with the
    languages allowed to each. A set grows by the language of the next greatest share until that doesn't pay.
    """
    n_docs, n_langs = one.shape
    everyone = np.arange(n_docs)
    full, _ = em(np.ones((n_docs, n_langs), np.float32), everyone)
    order = np.argsort(-full, axis=1, kind="stable")
    cost = penalty * np.log(sizes + 1.0)
    best_set = np.arange(n_langs)[None, :] == np.argmax(one, axis=1)[:, None]
    best, best_share = one.max(axis=1), best_set.astype(float)
    growing, m = everyone, 2
    while len(growing) and m <= n_langs:
        allowed = np.zeros((len(growing), n_langs), np.float32)
        np.put_along_axis(allowed, order[growing, :m], 1, axis=1)
        part, likely = em(allowed, growing)
        gain = likely - cost[growing] * (m - 1)
        better = gain > best[growing]
        growing, part, allowed = growing[better], part[better], allowed[better]
        best[growing] = gain[better]
        best_set[growing], best_share[growing] = allowed > 0, part
        m += 1
    return best_share, best_set, full


def solve(data: bytes, starts_at: np.ndarray, table: np.ndarray, penalty: float = 2.0, rounds: int = 8, most: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For documents laid end to end in ``data``, all document x language: proportions, whether chosen,
    and the proportions when all languages are allowed.

    Documents without a word have no proportions (all zero). ``most`` is how many bytes are scored at a time.
    """
    n_docs, n_langs = len(starts_at), table.shape[1]
    share, chosen, sure = np.zeros((n_docs, n_langs)), np.zeros((n_docs, n_langs), bool), np.zeros((n_docs, n_langs))
    if not n_langs:
        return share, chosen, sure
    most = most or CHUNK // n_langs
    if n_docs == 1 and len(data) > HELD * most:
        return _long(data, table, penalty, rounds, most)
    parts = [(a, *_scores(data[a:b], table)) for a, b in _pieces(data, most)]
    score, place = np.concatenate([x for _, x, _ in parts] or [np.zeros((0, n_langs))]), np.concatenate([a + x for a, _, x in parts] or [np.zeros(0, np.int64)])
    if not len(score):
        return share, chosen, sure
    owner = np.searchsorted(starts_at, place, side="right") - 1
    some, starts = np.unique(owner, return_index=True)
    sizes = np.diff(np.append(starts, len(owner)))
    doc = np.repeat(np.arange(len(some)), sizes)
    top = score.max(axis=1, keepdims=True)
    words = np.exp(np.maximum(score - top, -60))
    one = np.add.reduceat((score - top).astype(np.float64), starts, axis=0)

    def em(allowed: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if len(of) == len(some):
            return _em(words, doc, starts, allowed, rounds)
        rows = np.isin(doc, of)
        counts = sizes[of]
        return _em(words[rows], np.repeat(np.arange(len(of)), counts), np.cumsum(counts) - counts, allowed, rounds)

    share[some], chosen[some], sure[some] = _grow(one, sizes, em, penalty)
    return share, chosen, sure


def _predict(langs: list[str], table: np.ndarray, penalty: float):
    def flush(ids: list, texts: list) -> pa.RecordBatch:
        data, at, offsets = [], 0, []
        for text in texts:
            offsets.append(at)
            data.append(letters(text or ""))
            at += len(data[-1])
        share, chosen, sure = solve(b"".join(data), np.array(offsets), table, penalty)
        pred, score, mixes = [], [], []
        for i, text in enumerate(texts):
            if not has_letter(text) or not chosen[i].any():
                pred.append(UNKNOWN)
                score.append(0.0)
                mixes.append([])
                continue
            k = int(np.argmax(share[i]))
            pred.append(langs[k])
            score.append(float(min(1.0, max(0.0, sure[i][k]))))
            mixes.append([{"lang": langs[j], "share": float(share[i][j])} for j in np.argsort(-share[i], kind="stable") if chosen[i][j]])
        kind = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(mixes, kind)], names=["doc_id", "lang_pred", "score", "languages"])

    most = CHUNK // max(1, len(langs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            first, size = 0, 0
            for i, text in enumerate(texts):
                more = 4 * len(text or "") if text and not text.isascii() else len(text or "")
                if size and size + more > most:
                    yield flush(ids[first:i], texts[first:i])
                    first, size = i, 0
                size += more + 2
            if first < len(texts):
                yield flush(ids[first:], texts[first:])

    return run


def identify(docs: DataFrame, langs: list[str], table: np.ndarray, penalty: float = 2.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, languages (array of lang and share, greatest first); one row for each row of ``docs``.

    ``lang_pred`` has the greatest share of the chosen set; ``score`` is its share when all
    languages are allowed. A text that is null or has no letter, or a model without languages, gives
    'und' with score 0. Repeated rows repeat their result; an empty table gives an empty result; other
    columns are ignored.
    """
    own = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return own.mapInArrow(lean(_predict(langs, table, penalty), 1000), "doc_id long, lang_pred string, score double, languages array<struct<lang:string,share:double>>")


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text is 1 modulo 3; such documents are not learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train_and_identify(docs: DataFrame, train_rows: int = TRAIN_ROWS, penalty: float = 2.0, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Fits on the labelled documents that are not held out, then identifies all; see :func:`identify`."""
    own = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"), docs[lang_col].cast("string").alias("lang"))
    labelled = own.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    langs, table = fit(labelled, train_rows)
    return identify(own, langs, table, penalty)


def _keep(langs: list[str], table: np.ndarray, penalty: float, text_at: int, lang_at: int):
    predict = _predict(langs, table, penalty)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            own = pa.RecordBatch.from_arrays([pa.array(np.arange(batch.num_rows)), batch.column(text_at)], names=["doc_id", "text"])
            found = [x for out in predict(iter([own])) for x in out.column("lang_pred").to_pylist()]
            columns = list(batch.columns)
            known = columns[lang_at].to_pylist()
            columns[lang_at] = pa.array([k if k is not None else f for k, f in zip(known, found, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names).filter(pa.array([f != UNKNOWN for f in found]))

    return run


def keep_identified(docs: DataFrame, train_rows: int = TRAIN_ROWS, penalty: float = 2.0, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``docs`` with its own columns, without the documents whose language can't be told; a null language is filled in.

    Models are fitted on the labelled documents that are not held out. Text and language are strings.
    """
    own = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"), docs[lang_col].alias("lang"))
    langs, table = fit(own.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"))), train_rows)
    return docs.mapInArrow(lean(_keep(langs, table, penalty, docs.columns.index(text_col), docs.columns.index(lang_col)), 1000), docs.schema)
