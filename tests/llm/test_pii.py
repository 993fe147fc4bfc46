import datetime
import hashlib
import random
import re

import pytest

from blockloom.llm import pii

KEY = "test key"


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        v = int(c) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def mod97(s):
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97


TEXTS = {
    1: "call +1 (743) 555-3824 or +1 (743) 555-3824, also (212) 555-0100; mail to hein.19@mail5.example.com&&& now",
    2: "card 4785380592391139 4785380592391139 and 4012-8888-8888-1881, not 4785380592391138; from 233.233.171.252 not 300.1.1.1 or 1.2.3.4.5",
    3: "ssn 123-45-6789, bad 000-12-3456, born 1984-02-29 or 1985-02-29, seen 2001/12/31; IBAN DE89370400440532013000 and DE89370400440532013001",
    4: 'token = "11acdfb36bb72224148e6160f674b4be4560" x',
    5: None,
    6: "",
    7: "nothing here, é\U0001f600 12 and 2024",
    8: "mail to hein.19@mail5.example.com again; 233.233.171.252",
}


@pytest.fixture(scope="module")
def found(spark):
    frame = spark.createDataFrame([(k, v, "x") for k, v in TEXTS.items()], "doc_id long, text string, m string")
    return {r.doc_id: r for r in pii.pseudonymize(frame, KEY).collect()}


def test_counts_and_untouched_texts(found):
    assert {k: r.n_pii for k, r in found.items()} == {1: 4, 2: 4, 3: 4, 4: 1, 5: 0, 6: 0, 7: 0, 8: 2}
    assert found[5].text is None and found[6].text == "" and found[7].text == TEXTS[7]
    assert found[2].n_card == 3 and found[2].n_ip == 1 and found[3].n_date == 2 and found[3].n_iban == 1 and found[3].n_ssn == 1


def test_formats_hold_and_values_stay_linked(found):
    one, two = re.findall(r"\+1 \(\d{3}\) \d{3}-\d{4}", found[1].text)
    assert one == two and "743" not in one[:8] and int(one[4:7]) >= 200 and int(one[9:12]) >= 200
    assert "hein.19@" not in found[1].text and re.search(r"u[0-9a-f]{10}@mail5\.example\.com&&&", found[1].text)
    cards = re.findall(r"\d{16}", found[2].text)
    assert cards[0] == cards[1] != "4785380592391139" and luhn(cards[0]) and cards[2] == "4785380592391138"
    dashed = re.search(r"\d{4}-\d{4}-\d{4}-\d{4}", found[2].text)[0]
    assert luhn(dashed.replace("-", "")) and dashed != "4012-8888-8888-1881"
    ip = re.search(r"from (\S+) ", found[2].text)[1]
    assert ip != "233.233.171.252" and all(int(o) < 256 for o in ip.split(".")) and ip in found[8].text
    assert "300.1.1.1" in found[2].text and "1.2.3.4.5" in found[2].text
    new = re.search(r"born (\S+) or 1985-02-29, seen (\d{4}/\d\d/\d\d); IBAN (\S+) and DE89370400440532013001", found[3].text)
    assert datetime.date.fromisoformat(new[1]) != datetime.date(1984, 2, 29) and mod97(new[3]) == 1 and new[3] != "DE89370400440532013000"
    assert "bad 000-12-3456" in found[3].text and "123-45-6789" not in found[3].text
    assert re.fullmatch(r'token = "[0-9a-f]{36}" x', found[4].text) and "11acdf" not in found[4].text


def test_the_permutations_undo_and_never_collide(spark):
    rows = [(i, f"{i // 250 + 1}.{i % 250}.7.{i % 199} +1 (4{i % 100:02d}) 555-{i:04d} {datetime.date(1900, 1, 1) + datetime.timedelta(days=i * 13)}") for i in range(2000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    there = pii.pseudonymize(frame, KEY)
    texts = {r.doc_id: r.text for r in there.collect()}
    for part in range(3):
        cut = re.compile(r"^(\S+) (\+1 \S+ \S+) (\S+)$")
        assert len({cut.match(t)[part + 1] for t in texts.values()}) == len({cut.match(t)[part + 1] for _, t in rows})
    assert {r.doc_id: r.text for r in pii.pseudonymize(there, KEY, back=True).collect()} == dict(rows)
    assert {r.doc_id: r.text for r in pii.pseudonymize(frame, "other").collect()} != texts


def test_corpus_edges(docs, none, corpus):
    assert pii.pseudonymize(none, KEY).count() == 0
    assert pii.pseudonymize(docs, KEY).count() == len(corpus)


@pytest.mark.parametrize("word", ["TOKEN", "Secret", "PASSWORD", "Passwd", "API_KEY"])
def test_secrets_of_any_case(spark, word):
    value = "9233A8EC11ACDFB36BB72224148E6160F674"
    frame = spark.createDataFrame([(1, f'{word} = "{value}" x')], "doc_id long, text string")
    found = pii.pseudonymize(frame, KEY).first()
    assert found.n_secret == found.n_pii == 1 and value not in found.text
    assert re.fullmatch(word + r' = "[0-9a-f]{36}" x', found.text)


LONG = {
    "dotted labels": "x a@" + "b." * 500_000 + "c y",
    "hyphens": "a@" + "b-" * 300_000 + " y",
    "one label": "a@" + "b" * 1_000_000 + " y",
    "at signs": "a@b.c" * 100_000,
    "bare at signs": "@" * 1_000_000,
    "digits": "1" * 1_000_000,
    "dots": "." * 1_000_000,
    "numbered dots": "1." * 400_000,
    "octets": "1.2.3.4 " * 20_000,
    "capitals": "AB12" * 200_000,
    "quotes": 'key="' * 150_000 + "a" * 300_000,
    "white space": "key" + " " * 1_000_000 + "=",
}


@pytest.mark.parametrize("kind", LONG)
def test_long_texts(spark, kind):
    frame = spark.createDataFrame([(1, LONG[kind])], "doc_id long, text string")
    found = pii.pseudonymize(frame, KEY).first()
    if kind == "dotted labels":
        assert found.n_email == 1 and re.fullmatch(r"x p[0-9a-f]{10}u[0-9a-f]{10}@" + re.escape("b." * 500_000) + "c y", found.text)
    if kind == "octets":
        assert found.n_ip == 20_000
    if kind in ("digits", "dots", "one label", "bare at signs", "white space"):
        assert found.n_pii == 0 and found.text == LONG[kind]


def feistel(kind, a, b, left, right):
    """The rounds, written again: ten digits of a keyed hash are added to one half, modulo its size."""
    key = hashlib.sha256(KEY.encode()).hexdigest()
    for i in range(8):
        if i % 2 == 0:
            left = (left + int(hashlib.sha256(f"{key}:{kind}:{i}:{right}".encode()).hexdigest()[:12], 16)) % a
        else:
            right = (right + int(hashlib.sha256(f"{key}:{kind}:{i}:{left}".encode()).hexdigest()[:12], 16)) % b
    return left, right


def with_check_digit(d):
    return next(d + str(c) for c in range(10) if luhn(d + str(c)))


def test_pseudonyms_equal_an_independent_feistel(spark):
    rnd = random.Random(3)
    day = datetime.date(1900, 1, 1)
    want, rows = {}, []
    for i in range(300):
        card = with_check_digit("".join(rnd.choice("0123456789") for _ in range(15)))
        l, r = feistel("card", 10**7, 10**8, int(card[:7]), int(card[7:15]))
        new_card = with_check_digit(f"{l:07d}{r:08d}")
        o = [rnd.randrange(256) for _ in range(4)]
        l, r = feistel("ip", 65536, 65536, o[0] * 256 + o[1], o[2] * 256 + o[3])
        new_ip = f"{l // 256}.{l % 256}.{r // 256}.{r % 256}"
        n = rnd.randrange(17 * 4297)
        l, r = feistel("date", 17, 4297, n // 4297, n % 4297)
        new_day = day + datetime.timedelta(days=l * 4297 + r)
        area = rnd.choice([x for x in range(1, 900) if x != 666])
        group, serial = rnd.randrange(1, 100), rnd.randrange(1, 10_000)
        l, r = feistel("ssn", 898, 989901, area - 1 - (area > 666), (group - 1) * 9999 + serial - 1)
        new_area = l + 1 + (l >= 665)
        new_ssn = f"{new_area:03d}-{r // 9999 + 1:02d}-{r % 9999 + 1:04d}"
        p = [rnd.randrange(200, 1000), rnd.randrange(200, 1000), rnd.randrange(10_000)]
        l, r = feistel("phone", 640_000, 10_000, (p[0] - 200) * 800 + p[1] - 200, p[2])
        new_phone = f"+1 ({l // 800 + 200}) {l % 800 + 200}-{r:04d}"
        bban = f"{rnd.randrange(10**18):018d}"
        check = 98 - mod97("DE00" + bban)
        l, r = feistel("iban", 10**9, 10**9, int(bban[:9]), int(bban[9:]))
        new_iban = f"DE{98 - mod97(f'DE00{l:09d}{r:09d}'):02d}{l:09d}{r:09d}"
        rows.append((i, f"{card} | {o[0]}.{o[1]}.{o[2]}.{o[3]} | {day + datetime.timedelta(days=n)} | {area:03d}-{group:02d}-{serial:04d} | +1 ({p[0]}) {p[1]}-{p[2]:04d} | DE{check:02d}{bban}"))
        want[i] = f"{new_card} | {new_ip} | {new_day} | {new_ssn} | {new_phone} | {new_iban}"
    got = {r.doc_id: r.text for r in pii.pseudonymize(spark.createDataFrame(rows, "doc_id long, text string"), KEY).collect()}
    assert got == want


def test_the_key_is_in_no_plan(spark):
    frame = spark.createDataFrame([(1, "1.2.3.4")], "doc_id long, text string")
    found = pii.pseudonymize(frame, KEY)
    assert found.first().n_ip == 1
    plans = found._jdf.queryExecution().toString()
    assert KEY not in plans and hashlib.sha256(KEY.encode()).hexdigest() not in plans


def test_addresses_of_one_domain_stay_apart(spark):
    rows = [(i, f"user{i}@one.example.com user{i}@two.example.com") for i in range(500)]
    found = [w for r in pii.pseudonymize(spark.createDataFrame(rows, "doc_id long, text string"), KEY).collect() for w in r.text.split()]
    assert len({w.split("@")[0] for w in found}) == 1000
