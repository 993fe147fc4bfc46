"""DuckDB SQL of operators whose rows need byte windows, all cosines, or XXH64, which DuckDB lacks.

XXH64 is spelled out in 128-bit arithmetic: products are taken modulo 2**64, and a rotation by r is a product with 2**r
modulo 2**64 - 1. Texts are hexadecimal there, two digits a byte.
"""

from __future__ import annotations

_WORDS = r"[^\x20\x09-\x0D]+"

# Fixed values of XXH64.
P1 = 11400714785074694791
P2 = 14029467366897019727
P3 = 1609587929392839161
P4 = 9650029242287828579
P5 = 2870177450012600261
ROTATIONS = (1, 7, 12, 18)

_SPACE = 1 << 64


def _int(value: int) -> str:
    return f"{value}::UHUGEINT"


def _mod(x: str) -> str:
    return f"(({x}) % {_int(_SPACE)})"


def _times(x: str, factor: int) -> str:
    return _mod(f"({x}) * {_int(factor)}")


def _rotate(x: str, by: int) -> str:
    return f"((({x}) * {_int(1 << by)}) % {_int(_SPACE - 1)})"


def _bytes(at: str, n: int) -> str:
    """The little-endian number of n bytes of x, from the hexadecimal digit ``at`` on."""
    return "('0x' || " + " || ".join(f"substr(x, {at} + {2 * i + 1}, 2)" for i in reversed(range(n))) + ")::UBIGINT::UHUGEINT"


def _round(state: str, lane: str) -> str:
    return _times(_rotate(_mod(f"{state} + {_times(lane, P2)}"), 31), P1)


def _shifted(by: int) -> str:
    return f"xor(h, h // {_int(1 << by)})"


def xxh64(source: str, name: str) -> str:
    """Common table expressions; the last, ``name``, has (seed, x, h UBIGINT) for the distinct (seed UHUGEINT, x) of ``source``."""
    starts = ((P1 + P2) % _SPACE, P2, 0, -P1 % _SPACE)
    lanes = ", ".join(f"list_reduce(list_transform(range(0, stripes), lambda j: {_bytes(f'64 * j + {16 * k}', 8)}), lambda v, lane: {_round('v', 'lane')}, {_mod(f'seed + {_int(start)}')}) AS v{k}" for k, start in enumerate(starts))
    merged = _mod(" + ".join(_rotate(f"v{k}", by) for k, by in enumerate(ROTATIONS)))
    for k in range(4):
        merged = _mod(f"{_times(f'xor({merged}, {_round(_int(0), f"v{k}")})', P1)} + {_int(P4)}")
    eight = _mod(_times(_rotate(f"xor(h, {_round(_int(0), 'lane')})", 27), P1) + f" + {_int(P4)}")
    four = _mod(_times(_rotate(f"xor(h, {_times(_bytes('16 * (n // 8)', 4), P1)})", 23), P2) + f" + {_int(P3)}")
    one = _times(_rotate(f"xor(h, {_times('byte', P5)})", 11), P1)
    return f"""
{name}0 AS (SELECT DISTINCT seed, x, length(x) // 2 AS n, length(x) // 64 AS stripes FROM {source}),
{name}1 AS (SELECT *, {lanes} FROM {name}0),
{name}2 AS (SELECT seed, x, n, stripes, {_mod(f"CASE WHEN n >= 32 THEN {merged} ELSE seed + {_int(P5)} END + n::UHUGEINT")} AS h FROM {name}1),
{name}3 AS (SELECT seed, x, n, list_reduce(list_transform(range(4 * stripes, n // 8), lambda j: {_bytes('16 * j', 8)}), lambda h, lane: {eight}, h) AS h FROM {name}2),
{name}4 AS (SELECT seed, x, n, CASE WHEN n % 8 >= 4 THEN {four} ELSE h END AS h FROM {name}3),
{name}5 AS (SELECT seed, x, list_reduce(list_transform(range(n // 4 * 4, n), lambda j: {_bytes('2 * j', 1)}), lambda h, byte: {one}, h) AS h FROM {name}4),
{name}6 AS (SELECT seed, x, {_times(_shifted(33), P2)} AS h FROM {name}5),
{name}7 AS (SELECT seed, x, {_times(_shifted(29), P3)} AS h FROM {name}6),
{name} AS MATERIALIZED (SELECT seed, x, {_shifted(32)}::UBIGINT AS h FROM {name}7)"""


def repeats(length: int) -> str:
    """Byte strings of ``length`` that start more than once, counted by their MD5; their covered bytes go."""
    return f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, encode(coalesce(text, '')) AS b FROM documents),
n AS (SELECT rid, doc_id, b, octet_length(b)::BIGINT AS n_bytes FROM d),
w AS (SELECT rid, s, md5(array_slice(b, s, s + {length - 1})) AS h FROM (SELECT rid, b, unnest(range(1, n_bytes - {length - 2})) AS s FROM n WHERE n_bytes >= {length})),
t AS MATERIALIZED (SELECT rid, s FROM w JOIN (SELECT h FROM w GROUP BY h HAVING count(*) > 1) USING (h)),
g AS (SELECT rid, s, s > {length} + coalesce(lag(s) OVER (PARTITION BY rid ORDER BY s), -{length}) AS opens FROM t),
i AS (SELECT rid, s, sum(opens::INT) OVER (PARTITION BY rid ORDER BY s) AS run FROM g),
r AS (SELECT rid, min(s) AS lo, max(s) + {length} AS hi FROM i GROUP BY rid, run),
e AS (SELECT rid, lo, hi, lag(hi, 1, 1::BIGINT) OVER (PARTITION BY rid ORDER BY lo) AS done FROM r),
x AS (SELECT rid, sum(hi - lo)::BIGINT AS n_removed, count(*)::BIGINT AS n_spans, max(hi) AS last,
             string_agg(hex(array_slice(b, done, lo - 1)), '' ORDER BY lo) AS kept
      FROM e JOIN n USING (rid) GROUP BY rid)
SELECT doc_id, n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(CASE WHEN x.rid IS NULL THEN b ELSE unhex(kept || hex(array_slice(b, last, n_bytes))) END) AS kept_sha256
FROM n LEFT JOIN x USING (rid)
"""


def simhash(words: int, distance: int) -> str:
    """Fingerprints from the bits of all shingles, compared one with another; components by reach."""
    bits = ", ".join(f"sum(h >> {b} & 1) AS s{b}" for b in range(64))
    value = " + ".join(f"(2 * s{b} > n)::UBIGINT * {1 << b}" for b in range(64))
    return rf"""
WITH RECURSIVE d AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORDS}') AS w
  FROM documents),
s AS MATERIALIZED (
  SELECT rid, 42::UHUGEINT AS seed, hex(encode(array_to_string(w[i : i + {words - 1}], ' '))) AS x
  FROM (SELECT rid, w, unnest(range(1, greatest(len(w) - {words - 1}, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
{xxh64("s", "z")},
c AS (SELECT rid, count(*) AS n, {bits} FROM s JOIN z USING (x) GROUP BY rid),
p AS MATERIALIZED (SELECT doc_id, coalesce(fp, 0)::UBIGINT AS fp FROM d LEFT JOIN (SELECT rid, ({value})::UBIGINT AS fp FROM c) USING (rid)),
f AS MATERIALIZED (SELECT fp, min(doc_id) AS least FROM p GROUP BY fp),
e AS MATERIALIZED (SELECT a.fp AS a, b.fp AS b FROM f a JOIN f b ON bit_count(xor(a.fp, b.fp)) <= {distance}),
g(a, b) AS (SELECT a, b FROM e UNION SELECT g.a, e.b FROM g JOIN e ON e.a = g.b),
k AS (SELECT g.a AS fp, min(f.least) AS component_id FROM g JOIN f ON f.fp = g.b GROUP BY g.a)
SELECT doc_id, lpad(lower(to_hex(fp)), 16, '0') AS fingerprint, component_id FROM p JOIN k USING (fp)
"""


def sketches(k: int, words: int) -> str:
    """Bottom-k sketches of each text and its edited text; a shingle's hash takes each word with the hash so far as seed.

    Ids are taken to be distinct, and at most one null.
    """
    steps, top = [], 1 << 63
    for j in range(words):
        steps.append(f"q{j} AS MATERIALIZED (SELECT a.rid, a.kind, a.i, a.h AS seed, w.x FROM a{j} a LEFT JOIN w ON w.rid = a.rid AND w.kind = a.kind AND w.pos = a.i + {j})")
        steps.append(f"u{j} AS (SELECT seed, x FROM q{j} WHERE x IS NOT NULL)")
        steps.append(xxh64(f"u{j}", f"z{j}x"))
        steps.append(f"a{j + 1} AS (SELECT q.rid, q.kind, q.i, coalesce(z.h::UHUGEINT, q.seed) AS h FROM q{j} q LEFT JOIN z{j}x z ON z.seed = q.seed AND z.x = q.x)")
    near = f"(CASE WHEN len({{u}}) = 0 THEN 1 ELSE len(list_intersect({{u}}, list_intersect({{a}}, {{b}})))::DOUBLE / len({{u}}) END)::DOUBLE"

    def likeness(b: str) -> str:
        return near.format(u=f"list_sort(list_distinct(list_concat(o.k, {b}.k)))[1:{k}]", a="o.k", b=f"{b}.k")

    def text(a: str) -> str:
        return f"array_to_string(list_transform({a}.k, lambda v: lpad(lower(to_hex(xor(v, {top}::UBIGINT))), 16, '0')), '')"

    return rf"""
WITH d AS MATERIALIZED (SELECT row_number() OVER (ORDER BY doc_id DESC NULLS LAST) AS rid, doc_id, coalesce(text, '') AS t FROM documents),
n AS MATERIALIZED (
  SELECT d.rid, d.doc_id, e.rid AS next, length(d.t) AS n_chars, d.t, left(d.t, length(d.t) - length(d.t) // 3) || left(e.t, length(d.t) // 3) AS edited
  FROM d JOIN d e ON e.rid = d.rid % (SELECT count(*) FROM d) + 1),
l AS MATERIALIZED (
  SELECT rid, kind, regexp_extract_all(lower(t), '{_WORDS}') AS w
  FROM (SELECT rid, 0 AS kind, t FROM n UNION ALL SELECT rid, 1, edited FROM n)),
w AS MATERIALIZED (SELECT rid, kind, unnest(range(1, len(w) + 1)) AS pos, unnest(list_transform(w, lambda v: hex(encode(v)))) AS x FROM l),
a0 AS (SELECT rid, kind, unnest(range(1, greatest(len(w) - {words - 1}, 1) + 1)) AS i, 42::UHUGEINT AS h FROM l WHERE len(w) > 0),
{", ".join(steps)},
b AS (SELECT rid, kind, list_sort(list(DISTINCT xor(h::UBIGINT, {top}::UBIGINT)))[1:{k}] AS k FROM a{words} GROUP BY rid, kind),
m AS MATERIALIZED (SELECT l.rid, l.kind, coalesce(b.k, []) AS k FROM l LEFT JOIN b USING (rid, kind))
SELECT n.doc_id, n.n_chars::BIGINT AS n_chars, sha256(n.edited) AS edited_sha256, {text("o")} AS fingerprint, {text("e")} AS edited_fingerprint,
       {likeness("e")} AS near_edited, {likeness("f")} AS near_next
FROM n JOIN m o ON o.rid = n.rid AND o.kind = 0 JOIN m e ON e.rid = n.rid AND e.kind = 1 JOIN m f ON f.rid = n.next AND f.kind = 0
"""


def nearest(every: int, top: int) -> str:
    """The exact nearest by brute force; what the search finds equals it where nothing is missed, as on the test tables."""
    return f"""
WITH v AS MATERIALIZED (
  SELECT vec_id, e, sqrt(list_reduce(list_transform(e, lambda x: x * x), lambda x, y: x + y)) AS norm
  FROM (SELECT DISTINCT vec_id, embedding::DOUBLE[] AS e FROM embeddings)
  WHERE vec_id IS NOT NULL AND len(list_filter(e, lambda x: x <> 0)) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id,
             greatest(-1::DOUBLE, least(1::DOUBLE, list_reduce(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2]), lambda x, y: x + y) / (q.norm * c.norm))) AS score
      FROM v q JOIN v c ON c.vec_id <> q.vec_id AND len(c.e) = len(q.e) WHERE q.vec_id % {every} = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score
FROM s QUALIFY rank <= {top}
"""
