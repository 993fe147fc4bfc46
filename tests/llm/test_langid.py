import math
import zlib

import numpy as np
import pytest

from blockloom.llm import langid


def sample():
    """Three made-up languages of different syllables, 300 words a text."""
    rnd = np.random.default_rng(3)
    syllables = {"aa": ["ka", "lo", "mi", "tu"], "bb": ["shr", "ent", "ing", "owd"], "cc": ["éç", "ñu", "öß", "üa"]}
    rows = []
    for i in range(240):
        lang = ("aa", "bb", "cc")[i % 3]
        rows.append((i, " ".join("".join(rnd.choice(syllables[lang], rnd.integers(1, 4))) for _ in range(rnd.integers(3, 80))), lang))
    return rows


def test_held_out_accuracy_and_edges(spark):
    rows = sample()
    extra = [(1000, None, "aa"), (1001, "", "aa"), (1002, "12 34 !!", "bb"), (1003, rows[0][1], None), (1003, rows[0][1], None), (None, rows[1][1], "bb"), (1004, "x" * 3_000_000, None), (1005, " ".join([rows[0][1]] * 1500), None)]
    frame = spark.createDataFrame([(*r, 0.5) for r in rows + extra], "doc_id long, text string, lang string, score double")
    found = langid.train_and_identify(frame).collect()
    assert len(found) == len(rows) + len(extra)
    by_id = {r.doc_id: r for r in found}
    held = [(by_id[i].lang_pred, lang) for i, _, lang in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert len(held) > 50 and sum(a == b for a, b in held) / len(held) > 0.97
    assert all(by_id[i].lang_pred == "und" and by_id[i].score == 0 for i in (1000, 1001, 1002))
    assert by_id[1003].lang_pred == "aa" and by_id[None].lang_pred == "bb" and by_id[1005].lang_pred == "aa"
    assert all(0 <= r.score <= 1 for r in found)


def test_a_mixed_document_gets_both_languages(spark):
    rows = sample()
    train = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    langs, table = langid.fit(train)
    a, b = (" ".join(t for _, t, lang in rows if lang == x)[:3000] for x in ("aa", "cc"))
    found = langid.identify(spark.createDataFrame([(1, a + " " + b), (2, a)], "doc_id long, text string"), langs, table).collect()
    mixed, pure = sorted(found, key=lambda r: r.doc_id)
    assert {x.lang for x in mixed.languages} == {"aa", "cc"} and abs(mixed.languages[0].share - 0.5) < 0.2
    assert [x.lang for x in pure.languages] == ["aa"] and pure.score > 0.9


def test_em_equals_one_document_at_a_time():
    rows = sample()[:12]
    rnd = np.random.default_rng(1)
    table = np.log(rnd.dirichlet(np.ones(langid.BUCKETS), 3).T).astype(np.float32)
    data, at, offsets = [], 0, []
    for _, text, _ in rows:
        offsets.append(at)
        data.append(langid.letters(text))
        at += len(data[-1])
    share, chosen, _ = langid.solve(b"".join(data), np.array(offsets), table)
    for i, piece in enumerate(data):
        alone, one, _ = langid.solve(piece, np.array([0]), table)
        assert np.allclose(alone[0], share[i], atol=1e-4) and (one[0] == chosen[i]).all()


def test_nothing_to_learn_from(spark):
    frame = spark.createDataFrame([(1, "some words", None)], "doc_id long, text string, lang string")
    assert langid.train_and_identify(frame).first().lang_pred == "und"
    assert langid.train_and_identify(frame.filter("doc_id = 2")).count() == 0


def brute_em(word_scores, penalty, rounds=8):
    """One document in plain Python: (set, shares of the set, shares of all) from each word's log-likelihoods."""
    n_langs = len(word_scores[0])

    def em(langs):
        share = {k: 1 / len(langs) for k in langs}
        for _ in range(rounds):
            total = dict.fromkeys(langs, 0.0)
            for scores in word_scores:
                top = max(scores)
                joint = {k: share[k] * math.exp(max(scores[k] - top, -60)) for k in langs}
                mass = max(sum(joint.values()), 1e-30)
                for k in langs:
                    total[k] += joint[k] / mass
            share = {k: total[k] / len(word_scores) for k in langs}
        likely = 0.0
        for scores in word_scores:
            top = max(scores)
            likely += math.log(max(sum(share[k] * math.exp(max(scores[k] - top, -60)) for k in langs), 1e-30))
        return share, likely

    everyone, _ = em(range(n_langs))
    order = sorted(range(n_langs), key=lambda k: -everyone[k])
    alone = [sum(s[k] - max(s) for s in word_scores) for k in range(n_langs)]
    best = alone.index(max(alone))
    found, value, shares = {best}, alone[best], {best: 1.0}
    for m in range(2, n_langs + 1):
        share, likely = em(order[:m])
        gain = likely - penalty * math.log(len(word_scores) + 1) * (m - 1)
        if gain <= value:
            break
        found, value, shares = set(order[:m]), gain, share
    return found, shares, everyone


def plain_scores(text, table):
    """Log-likelihoods of the words, by a loop over the trigrams of each."""
    out = []
    for word in "".join(c if c.isalpha() else " " for c in text.lower()).split():
        b = b" " + word.encode() + b" "
        rows = [((b[i] << 16 | b[i + 1] << 8 | b[i + 2]) * 2654435761 % (1 << 32)) >> 16 for i in range(len(b) - 2)]
        out.append([sum(float(table[r, k]) for r in rows) for k in range(table.shape[1])])
    return out


def test_mixtures_equal_one_document_in_plain_python(spark):
    rows = sample()
    langs, table = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    texts = [rows[i][1] + " " + rows[i + 1][1] for i in range(6)] + [rows[0][1], rows[2][1], " ".join(rows[i][1] for i in range(3))]
    data, offsets, at = [], [], 0
    for t in texts:
        offsets.append(at)
        data.append(langid.letters(t))
        at += len(data[-1])
    for most in (None, 300):
        share, chosen, sure = langid.solve(b"".join(data), np.array(offsets), table, most=most)
        for i, t in enumerate(texts):
            found, shares, everyone = brute_em(plain_scores(t, table), 2.0)
            assert set(np.flatnonzero(chosen[i])) == found
            assert all(abs(share[i][k] - shares[k]) < 1e-3 for k in found) and all(abs(sure[i][k] - everyone[k]) < 1e-3 for k in range(len(langs)))
            if most:  # the way of a document that is read anew in each round
                alone = langid.solve(data[i], np.array([0]), table, most=20)
                assert (alone[1][0] == chosen[i]).all() and np.allclose(alone[0][0], share[i], atol=1e-3) and np.allclose(alone[2][0], sure[i], atol=1e-3)
    assert any(len(brute_em(plain_scores(t, table), 2.0)[0]) > 1 for t in texts)


@pytest.mark.parametrize("text", ["½ ² ①", "12 ³", "\u201c…\u201d", "\U0001f600 \U0001f601", "Ⅷ ⅳ", "_ 1 _", "٣٤", " \n", "", None])
def test_texts_without_letters_have_no_language(spark, text):
    rows = sample()[:60]
    frame = spark.createDataFrame([*rows, (9001, text, None)], "doc_id long, text string, lang string")
    found = langid.train_and_identify(frame).filter("doc_id = 9001").first()
    assert found.lang_pred == "und" and found.score == 0
    assert 9001 not in {r.doc_id for r in langid.keep_identified(frame).collect()}


def test_punctuation_beyond_ascii_parts_words_and_feeds_no_model():
    assert langid.letters("«Été» — “x”½\U0001f600y").split() == ["été".encode(), b"x", b"y"]


def test_two_hundred_languages_are_all_learned(spark):
    rnd = np.random.default_rng(5)
    letters = "abcdefghijklmnopqrstuvwxyz"
    rows = []
    for k in range(200):
        words = ["".join(rnd.choice(list(letters), rnd.integers(3, 8))) for _ in range(12)]
        rows += [(k * 10 + i, " ".join(rnd.choice(words, 40)), f"l{k:03d}") for i in range(10)]
    found = {r.doc_id: r for r in langid.train_and_identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert len({r.lang_pred for r in found.values()}) == 200
    assert sum(found[i].lang_pred == lang for i, _, lang in rows) / len(rows) > 0.99


def test_a_set_grows_beyond_four_languages(spark):
    rnd = np.random.default_rng(6)
    words = {k: ["".join(rnd.choice(list("abcdefghijklmnopqrstuvwxyz"), 7)) for _ in range(12)] for k in range(7)}
    rows = [(k * 10 + i, " ".join(rnd.choice(words[k], 60)), f"l{k}") for k in range(7) for i in range(9)]
    mixed = (999, " ".join(" ".join(rnd.choice(words[k], 50)) for k in range(6)), None)
    found = langid.train_and_identify(spark.createDataFrame([*rows, mixed], "doc_id long, text string, lang string")).filter("doc_id = 999").first()
    assert {x.lang for x in found.languages} == {f"l{k}" for k in range(6)}


def test_a_row_in_a_third_of_the_table_is_learned_from_once(spark):
    rows = sample() + [(7000, sample()[0][1], "aa")] * 120 + [(None, sample()[1][1], "bb")] * 120
    found = langid.train_and_identify(spark.createDataFrame(rows, "doc_id long, text string, lang string"), train_rows=100)
    assert found.count() == len(rows)
