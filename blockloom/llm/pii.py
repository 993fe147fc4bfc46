"""PII: format-preserving Feistel pseudonyms, in DataFrame functions alone.

Candidates are found by one pattern, validated (Luhn, mod 97, octets, calendar, number plans), and
numbered within the set of valid values of their format: (l, r) with 0 <= l < a, 0 <= r < b. Eight
keyed Feistel rounds permute a x b: l gains F(r) modulo a, r gains F(l) modulo b, in turn. So a
card stays a card with a right check digit, a date stays a date of 1900 to 2099, different values
stay different, and equal values get equal pseudonyms in every document. Mail addresses and
hexadecimal secrets, which number no such set, get keyed hashes of the same shape.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
KINDS = ("email", "phone", "ip", "card", "ssn", "iban", "date", "secret")

_LABEL = r"[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?"
#: A group that repeats without a bound is possessive: the engine then takes it in a loop, else by recursion, whose
#: stack a long text would overflow. What follows a label can't begin another, so nothing is lost.
#: What may be personal: mail, secret, phone, IPv4, date, social security number, IBAN, card.
PATTERN = "|".join(
    (
        rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@{_LABEL}(?:\.{_LABEL})++",
        r"(?<=(?i:token|secret|password|passwd|key)\s{0,2}[=:]\s{0,2}[\x22\x27])[0-9a-fA-F]{16,}(?=[\x22\x27])",
        r"(?<![\w+])\+1[ .-]?\(?\d{3}\)?[ .-]?\d{3}[ .-]?\d{4}(?!\d)",
        r"(?<![\w(])\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)",
        r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\.?\d)",
        r"(?<![\d/-])(?:19|20)\d{2}-\d{2}-\d{2}(?![\d-])",
        r"(?<![\d/-])(?:19|20)\d{2}/\d{2}/\d{2}(?![\d/])",
        r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
        r"(?<![A-Z0-9])[A-Z]{2}\d{2}[A-Z0-9]{11,30}(?![A-Z0-9])",
        r"(?<!\d)\d{4}(?<sep>[ -])\d{4}\k<sep>\d{4}\k<sep>\d{4}(?!\d)",
        r"(?<!\d)\d{13,19}(?!\d)",
    )
)
#: A text without any of these has no candidate.
HINT = r"[0-9@]|[=:]\s{0,2}[\x22\x27]"


def _sql(pattern: str) -> str:
    return "r'" + pattern + "'"


def _luhn(digits: str) -> str:
    """Luhn sum of a digit string."""
    one = f"cast(substr({digits}, length({digits}) - i + 1, 1) AS int)"
    return f"aggregate(sequence(1, length({digits})), 0, (s, i) -> s + if(i % 2 = 0, if({one} > 4, {one} * 2 - 9, {one} * 2), {one}))"


def _mod97(iban: str) -> str:
    """An IBAN modulo 97, letters as 10 to 35; 1 if valid."""
    moved = f"concat(substr({iban}, 5), substr({iban}, 1, 4))"
    value = "if(c BETWEEN '0' AND '9', (s * 10 + cast(try_cast(c AS int) AS int)) % 97, (s * 100 + ascii(c) - 55) % 97)"
    return f"aggregate(filter(split({moved}, ''), c -> c != ''), 0, (s, c) -> cast({value} AS int))"


def _kind() -> str:
    """The validated kind of a candidate ``h.m`` with digits ``h.d``; null if invalid."""
    octets = " AND ".join(f"cast(split_part(h.m, '.', {k}) AS int) <= 255" for k in (1, 2, 3, 4))
    return f"""CASE
        WHEN h.m LIKE '%@%' THEN 'email'
        WHEN h.m RLIKE {_sql(r"^[0-9]{1,3}([.][0-9]{1,3}){3}$")} THEN if({octets}, 'ip', NULL)
        WHEN h.m LIKE '+1%' OR h.m LIKE '(%' THEN 'phone'
        WHEN h.m RLIKE {_sql(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$")} THEN if(substr(h.m, 1, 3) NOT IN ('000', '666') AND h.m NOT LIKE '9%' AND substr(h.m, 5, 2) != '00' AND substr(h.m, 8) != '0000', 'ssn', NULL)
        WHEN h.m RLIKE {_sql(r"^[0-9]{4}[-/][0-9]{2}[-/][0-9]{2}$")} THEN if(try_cast(translate(h.m, '/', '-') AS date) IS NOT NULL, 'date', NULL)
        WHEN h.m RLIKE {_sql(r"^[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}$")} THEN if({_mod97("h.m")} = 1, 'iban', NULL)
        WHEN length(h.d) BETWEEN 13 AND 19 AND h.m RLIKE {_sql(r"^[0-9 -]+$")} THEN if({_luhn("h.d")} % 10 = 0, 'card', NULL)
        WHEN h.m RLIKE {_sql(r"^[0-9a-fA-F]{16,}$")} AND h.m RLIKE '[a-fA-F]' THEN 'secret' END"""


def _ten(n: str) -> str:
    return f"cast(rpad('1', cast({n} AS int) + 1, '0') AS bigint)"


def _domain() -> dict[str, tuple[str, str, str, str]]:
    """For each numbered kind: a, b, l and r of the value ``h``, in SQL."""
    n, big = "length(h.p)", "cast({} AS bigint)".format
    half, rest = f"substr(h.p, 1, {n} div 2)", f"substr(h.p, {n} div 2 + 1)"
    digits = (_ten(f"{n} div 2"), _ten(f"{n} - {n} div 2"), big(half), big(rest))
    octet = [f"cast(split_part(h.m, '.', {k}) AS bigint)" for k in (1, 2, 3, 4)]
    area, exchange, line = (big(f"substr(h.p, {a}, {k})") for a, k in ((1, 3), (4, 3), (7, 4)))
    plan = f"{area} >= 200 AND {exchange} >= 200"
    day = "cast(datediff(cast(translate(h.m, '/', '-') AS date), date '1900-01-01') AS bigint)"
    ssn = big("substr(h.m, 1, 3)")
    return {
        "card": digits,
        "iban": digits,
        "ip": ("65536L", "65536L", f"{octet[0]} * 256 + {octet[1]}", f"{octet[2]} * 256 + {octet[3]}"),
        "phone": (f"if({plan}, 640000L, 1000000L)", "10000L", f"if({plan}, ({area} - 200) * 800 + {exchange} - 200, {area} * 1000 + {exchange})", line),
        "ssn": ("898L", "989901L", f"{ssn} - 1 - if({ssn} > 666, 1, 0)", f"({big('substr(h.m, 5, 2)')} - 1) * 9999 + {big('substr(h.m, 8)')} - 1"),
        "date": ("17L", "4297L", f"{day} div 4297", f"{day} % 4297"),
    }


def _round(value: str) -> str:
    return f"cast(conv(substr(sha2(concat({_KEY}, ':', h.kind, ':', i, ':', {value}), 256), 1, 12), 16, 10) AS bigint)"


#: The column that holds the key.
_KEY = "_key"


def _permuted(back: bool) -> str:
    """(l, r) after the Feistel rounds, or before them."""
    sign = "-" if back else "+"
    left = f"named_struct('l', pmod(s.l {sign} {_round('s.r')}, h.a), 'r', s.r)"
    right = f"named_struct('l', s.l, 'r', pmod(s.r {sign} {_round('s.l')}, h.b))"
    steps = f"sequence({ROUNDS - 1}, 0)" if back else f"sequence(0, {ROUNDS - 1})"
    return f"aggregate({steps}, named_struct('l', h.l, 'r', h.r), (s, i) -> if(i % 2 = 0, {left}, {right}))"


def _pad(value: str, n: str) -> str:
    return f"lpad(cast({value} AS string), cast({n} AS int), '0')"


def _written() -> str:
    """The pseudonym of ``h`` in the format of ``h.m``."""
    n = "length(h.p)"
    digits = f"concat(if({n} div 2 = 0, '', {_pad('h.s.l', f'{n} div 2')}), {_pad('h.s.r', f'{n} - {n} div 2')})"
    # digits put back where the old ones stood
    fill = "array_join(transform(split({m}, ''), (c, i) -> if(c RLIKE '[0-9]', substr({d}, length(regexp_replace(substr({m}, 1, i + 1), '[^0-9]', '')), 1), c)), '')"
    check = f"cast((10 - {_luhn(f'concat({digits}, {chr(39)}0{chr(39)})')} % 10) % 10 AS string)"
    card = fill.format(m="h.m", d=f"concat({digits}, {check})")
    bban = fill.format(m="substr(h.m, 5)", d=digits)
    zero = f"concat(substr(h.m, 1, 2), '00', {bban})"
    iban = f"concat(substr(h.m, 1, 2), {_pad(f'98 - {_mod97(zero)}', '2')}, {bban})"
    ip = "concat_ws('.', h.s.l div 256, h.s.l % 256, h.s.r div 256, h.s.r % 256)"
    three = f"if(h.a = 640000, concat(h.s.l div 800 + 200, h.s.l % 800 + 200), {_pad('h.s.l', '6')})"
    country = "if(h.m LIKE '+1%', '1', '')"
    phone = fill.format(m="h.m", d=f"concat({country}, {three}, {_pad('h.s.r', '4')})")
    area = "h.s.l + 1 + if(h.s.l >= 665, 1, 0)"
    ssn = f"concat({_pad(area, '3')}, '-', {_pad('h.s.r div 9999 + 1', '2')}, '-', {_pad('h.s.r % 9999 + 1', '4')})"
    date = "translate(date_format(date_add(date '1900-01-01', cast(h.s.l * 4297 + h.s.r AS int)), 'yyyy-MM-dd'), '-', substr(h.m, 5, 1))"
    # 80 bits of the whole address, so that people of one domain stay apart; the domain itself stays
    hashed = f"sha2(concat({_KEY}, ':email:', h.m), 256)"
    email = f"concat('p', substr({hashed}, 1, 10), 'u', substr({hashed}, 11, 10), '@', split_part(h.m, '@', 2))"
    secret = f"substr(repeat(sha2(concat({_KEY}, ':secret:', h.m), 256), cast(ceil(length(h.m) / 64) AS int)), 1, length(h.m))"
    return f"CASE h.kind WHEN 'card' THEN {card} WHEN 'iban' THEN {iban} WHEN 'ip' THEN {ip} WHEN 'phone' THEN {phone} WHEN 'ssn' THEN {ssn} WHEN 'date' THEN {date} WHEN 'email' THEN {email} WHEN 'secret' THEN {secret} ELSE h.m END"


def pseudonymize(docs: DataFrame, key: str, back: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text (pseudonymised), n_pii and n_<kind> for each of :data:`KINDS`; one row for each row of ``docs``.

    ``key`` decides the pseudonyms. It enters the plan as a scalar subquery over a one-row table, so neither plans nor
    event logs show it or its hash. ``back`` undoes the permutations (numbers and dates; mail addresses and secrets are
    hashed and stay as they are). The domain of a mail address stays in clear.
    A null text stays null with no finds; an empty one stays empty; a text of any length is taken as a whole, at a cost
    linear in it; candidates that fail validation stay untouched; repeated rows repeat their result; an empty table
    gives an empty result; other columns are ignored.
    """
    hashed = hashlib.sha256(key.encode()).hexdigest()
    secret = docs.sparkSession.createDataFrame([(hashed,)], f"{_KEY} string")
    found = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"), F.lit(None).cast("array<string>").alias("m")).withColumn(_KEY, secret.scalar())
    hinted = F.col("text").rlike(HINT)
    found = found.withColumn("m", F.when(hinted, F.regexp_extract_all("text", F.lit(PATTERN), F.lit(0))))
    found = found.withColumn("m", F.when(F.size("m") > 0, F.col("m")))
    read = F.expr("transform(m, m -> named_struct('m', m, 'd', regexp_replace(m, '[^0-9]', '')))")
    found = found.withColumn("h", read)
    # p: the digits that are permuted
    part = "CASE WHEN h.kind = 'card' THEN substr(h.d, 1, length(h.d) - 1) WHEN h.kind = 'iban' THEN substr(h.d, 3) WHEN h.kind = 'phone' THEN right(h.d, 10) ELSE h.d END"
    found = found.withColumn("h", F.expr(f"transform(h, h -> named_struct('m', h.m, 'd', h.d, 'kind', {_kind()}))"))
    found = found.withColumn("h", F.expr(f"transform(h, h -> named_struct('m', h.m, 'kind', h.kind, 'p', {part}))"))
    domain = _domain()
    choose = lambda at, other: "CASE h.kind " + " ".join(f"WHEN '{k}' THEN {v[at]}" for k, v in domain.items()) + f" ELSE {other} END"
    found = found.withColumn("h", F.expr(f"transform(h, h -> named_struct('m', h.m, 'kind', h.kind, 'p', h.p, 'a', {choose(0, '1L')}, 'b', {choose(1, '1L')}, 'l', {choose(2, '0L')}, 'r', {choose(3, '0L')}))"))
    numbered = "h.kind IN (" + ", ".join(f"'{k}'" for k in domain) + ")"
    found = found.withColumn("h", F.expr(f"transform(h, h -> named_struct('m', h.m, 'kind', h.kind, 'p', h.p, 'a', h.a, 's', if({numbered}, {_permuted(back)}, named_struct('l', 0L, 'r', 0L))))"))
    written = f"if(h.kind IN ('email', 'secret'), h.m, {_written()})" if back else _written()
    found = found.withColumn("new", F.expr(f"transform(h, h -> coalesce({written}, h.m))"))
    found = found.withColumn("gaps", F.when(F.col("m").isNotNull(), F.split("text", PATTERN, -1)))
    # arrays stand outside the lambda, where an inlined one would be made anew for each element
    joined = F.expr("array_join(zip_with(gaps, new, (g, x) -> concat(g, coalesce(x, ''))), '')")
    kinds = F.coalesce(F.expr("filter(transform(h, h -> h.kind), k -> k IS NOT NULL)"), F.array().cast("array<string>"))
    counts = [F.size(F.filter("kinds", _same(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    done = found.select("doc_id", F.coalesce(joined, F.col("text")).alias("text"), kinds.alias("kinds"))
    return done.select("doc_id", "text", F.size("kinds").cast("long").alias("n_pii"), *counts)


def _same(kind: str):
    return lambda k: k == kind
