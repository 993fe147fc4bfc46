"""License scans by a positional rare-token index, in DataFrame functions alone.

The index is built from the templates below: each template word has an inverse document frequency
over the templates, and all rare words have postings (template, position). One pass over a file's words finds those of the
highest frequency in the index; a posting of word ``i`` of the file proposes template ``t`` at offset ``i - position``.
The proposals are sorted, so that equal ones, which different rare words make, stand together: a template is
proposed where enough of its rare words stand at their relative positions. It is held to if its mandatory key phrase stands
there word for word and enough of its words agree. The work grows with the words that are found, not with the templates.
Everything happens inside a row, so no text is shuffled and a licence that stands in a third of
all files costs no more than one that stands in few.
"""

from __future__ import annotations

import math
from collections import Counter
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Label, notice, mandatory key phrase (part of the notice).
TEMPLATES: tuple[tuple[str, str, str], ...] = (
    ("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2 0"),
    ("gpl-2", "licensed under the gnu general public license version 2", "gnu general public license version 2"),
    ("gpl-3", "licensed under the gnu general public license version 3", "gnu general public license version 3"),
    ("lgpl", "under the terms of the gnu lesser general public license", "gnu lesser general public license"),
    ("agpl", "under the terms of the gnu affero general public license", "gnu affero general public license"),
    ("gpl-notice", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gnu general public license"),
    ("mit", "released under the mit license", "the mit license"),
    ("mit-text", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "hereby granted free of charge"),
    ("bsd-text", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "source and binary forms"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license v 2 0"),
    ("isc-text", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "with or without fee"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", "cc by nc 4 0"),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", "cc by sa 4 0"),
    ("cc-by-4.0", "licensed under a creative commons attribution 4 0 international license", "creative commons attribution 4 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered software released into the public domain"),
    ("mit-notice", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "included in all copies or substantial portions"),
    ("mit-warranty", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement", "the software is provided as is"),
    ("bsd-endorse", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", "endorse or promote products derived from this software"),
    ("bsd-warranty", "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed", "provided by the copyright holders and contributors"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", "in no event will the authors be held liable"),
    ("boost-1.0", "distributed under the boost software license version 1 0", "boost software license version 1 0"),
    ("cc0-1.0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", "waived all copyright and related or neighboring rights"),
    ("epl-2.0", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0", "eclipse public license 2 0"),
    ("apache-text", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied", "distributed on an as is basis"),
    ("gpl-warranty", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose", "in the hope that it will be useful"),
    ("lgpl-notice", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation", "gnu lesser general public license"),
    ("ofl-1.1", "this font software is licensed under the sil open font license version 1 1", "sil open font license version 1 1"),
    ("psf-2", "licensed under the python software foundation license version 2", "python software foundation license version 2"),
    ("cddl", "this file is subject to the terms of the common development and distribution license", "common development and distribution license"),
    ("postgresql", "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted", "without a written agreement is hereby granted"),
)

#: The base phrases and their labels.
PHRASES: tuple[tuple[str, str], ...] = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

#: Words of a lower-cased text.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
NO_WORD = WORD.replace("^", "")
#: Function words, common in any prose and so never rare.
COMMON = frozenset("a and any are as by conditions for in into is it may met of on or out provided that the this to under use with without you".split())
#: A word is rare if at most so many templates have it.
RARE_IN = 6
#: Rare words that must stand at their relative positions (fewer if the template has fewer).
RARE_HITS = 2
#: The part of a template's words that must agree.
COVERAGE = 0.8


def idf() -> dict[str, float]:
    """Inverse document frequency of each template word, over the templates."""
    seen = Counter(w for _, notice, _ in TEMPLATES for w in set(notice.split()))
    return {w: math.log(len(TEMPLATES) / n) for w, n in seen.items()}


def rare_positions(template: int) -> list[int]:
    """Positions of a template's rare words, rarest first."""
    words, weight = TEMPLATES[template][1].split(), idf()
    least = math.log(len(TEMPLATES) / RARE_IN)
    return sorted((i for i, w in enumerate(words) if weight[w] >= least and w not in COMMON), key=lambda i: (-weight[words[i]], i))


def index() -> dict[str, list[tuple[int, int]]]:
    """Rare word to its postings (template, position); every rare word of every template is filed."""
    postings: dict[str, list[tuple[int, int]]] = {}
    for t, (_, notice, _) in enumerate(TEMPLATES):
        words = notice.split()
        for i in rare_positions(t):
            postings.setdefault(words[i], []).append((t, i))
    return postings


def _literal(value) -> str:
    """A Python value as an SQL literal: numbers, words, lists and dicts (structs) of them."""
    if isinstance(value, dict):
        return "named_struct(" + ", ".join(f"'{k}', {_literal(v)}" for k, v in value.items()) + ")"
    if isinstance(value, list):
        return f"array({', '.join(map(_literal, value))})"
    return f"'{value}'" if isinstance(value, str) else str(value)


def _key_at(template: int) -> tuple[int, int]:
    """Where a template's key phrase begins and ends."""
    parts, key = TEMPLATES[template][1].split(), TEMPLATES[template][2].split()
    at = next(i for i in range(len(parts)) if parts[i : i + len(key)] == key)
    return at, at + len(key)


def _starts(phrase: str) -> Column:
    """Where ``phrase`` stands in the words w."""
    same = " AND ".join(f"get(w, i + {k}) = '{part}'" for k, part in enumerate(phrase.split()))
    return F.expr(f"filter(sequence(0, size(w) - 1), i -> {same})")


#: A proposal is template * _AT + offset + _SHIFT: offsets may lie before the text.
_AT, _SHIFT = "4294967296L", "65536L"


def _needs() -> str:
    """How many rare words of each template must be in place, as an SQL array."""
    return _literal([min(RARE_HITS, len(rare_positions(t))) for t in range(len(TEMPLATES))])


def _hits() -> Column:
    """(i, x) of the indexed words in w, in one pass: membership in a literal list is a hash lookup."""
    words = ", ".join(f"'{w}'" for w in sorted(index()))
    return F.expr(f"filter(transform(w, (x, i) -> if(x IN ({words}), named_struct('i', i, 'x', x), NULL)), h -> h IS NOT NULL)")


def _proposals() -> Column:
    """Template t and offset at as one number (see :data:`_AT`), sorted, once for each rare word of the template in its place."""
    postings = ", ".join(f"'{w}', {_literal([{'t': t, 'pos': i} for t, i in found])}" for w, found in sorted(index().items()))
    return F.expr(f"array_sort(flatten(transform(hits, h -> transform(element_at(map({postings}), h.x), p -> p.t * {_AT} + h.i - p.pos + {_SHIFT}))))")


def _supported() -> Column:
    """The distinct proposals that enough rare words make."""
    first = "(k = 0 OR get(proposals, k - 1) != p)"
    return F.expr(f"filter(proposals, (p, k) -> {first} AND get(proposals, k + get({_needs()}, cast(p div {_AT} AS int)) - 1) = p)")


def _verified() -> Column:
    """Label and score of the supported proposals with their key phrase in place and enough words that agree."""
    table = _literal([{"label": label, "parts": notice.split(), "a": _key_at(t)[0], "b": _key_at(t)[1] - 1} for t, (label, notice, _) in enumerate(TEMPLATES)])
    with_template = f"transform(supported, p -> struct(cast(p % {_AT} - {_SHIFT} AS int) AS at, get({table}, cast(p div {_AT} AS int)) AS m))"
    agree = "get(w, x.at + j) = get(x.m.parts, j)"
    held = f"filter({with_template}, x -> forall(sequence(x.m.a, x.m.b), j -> coalesce({agree}, false)))"
    scored = f"transform({held}, x -> struct(x.m.label AS label, size(filter(sequence(0, size(x.m.parts) - 1), j -> {agree})) / double(size(x.m.parts)) AS score))"
    return F.expr(f"filter({scored}, x -> x.score >= {COVERAGE}D)")


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score; a row for each row of ``docs``.

    A-Z are lowered and the whole text is cut into words. ``n_base`` counts all places of the base
    phrases, ``first_word`` and ``last_word`` are the least and greatest start among them (null if
    none). ``labels`` joins the base labels and those of verified templates. ``score`` is the
    greatest part of a verified template's words that agree, else 0.5 if there is a base label,
    else 0. A null or empty text has no words and no labels; a text of any length is read whole, at a cost that grows with
    its words; repeated rows repeat their result; an
    empty table gives an empty result; other columns are ignored.
    """
    lowered = F.translate(F.coalesce(docs[text_col].cast("string"), F.lit("")), ascii_uppercase, ascii_lowercase)
    words = F.filter(F.split(lowered, NO_WORD), lambda x: x != "")
    cut = docs.select(docs[id_col].cast("long").alias("doc_id"), words.alias("w"))
    keys = sorted({*index(), *(p.split()[-1] for p, _ in PHRASES)})
    w = F.col("w")
    # files without any indexed word keep an empty list, so the steps below end at once
    flagged = cut.select("doc_id", F.size("w").cast("long").alias("n_words"), F.when(F.arrays_overlap(w, F.expr(_literal(keys))), w).otherwise(F.array().cast("array<string>")).alias("w"))
    none = F.array().cast("array<int>")
    some = F.size("w") > 0
    based = flagged.withColumns({f"p{k}": F.when(some, _starts(phrase)).otherwise(none) for k, (phrase, _) in enumerate(PHRASES)})
    looked_up = based.withColumn("hits", F.when(some, _hits()))
    proposed = looked_up.withColumn("proposals", F.when(F.size("hits") > 0, _proposals()))
    supported = proposed.withColumn("supported", F.when(F.size("proposals") > 0, _supported()))
    held = supported.withColumn("held", F.when(F.size("supported") > 0, _verified()))
    held = held.select("doc_id", "n_words", "held", *(f"p{k}" for k in range(len(PHRASES))))
    places = F.concat(*(F.col(f"p{k}") for k in range(len(PHRASES))))
    base = F.array_compact(F.array(*(F.when(F.size(f"p{k}") > 0, F.lit(label)) for k, (_, label) in enumerate(PHRASES))))
    found = F.coalesce(F.col("held"), F.array().cast("array<struct<label:string,score:double>>"))
    named = held.select("doc_id", "n_words", places.alias("places"), base.alias("base"), found.alias("found"))
    return named.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min("places").cast("long").alias("first_word"),
        F.array_max("places").cast("long").alias("last_word"),
        F.array_join(F.array_sort("base"), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat("base", F.col("found.label")))), ",").alias("labels"),
        F.coalesce(F.array_max(F.col("found.score")), F.when(F.size("base") > 0, F.lit(0.5)), F.lit(0.0)).alias("score"),
    )


def oracle_sql() -> str:
    """The same for DuckDB: words by position, joined with the templates' words."""
    rows = lambda values: ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in r) + ")" for r in values)
    parts, keys, filed = [], [], []
    for t, (label, notice, _) in enumerate(TEMPLATES):
        words, (a, b), rare = notice.split(), _key_at(t), rare_positions(t)
        parts += [(t, i, w, int(i in rare), int(a <= i < b)) for i, w in enumerate(words)]
        keys.append((t, label, len(words), b - a, min(RARE_HITS, len(rare))))
    filed = [(w, t, i) for w, p in index().items() for t, i in p]
    base = " UNION ALL ".join(
        f"SELECT w0.doc_id, '{label}' AS label, w0.i FROM w w0 "
        + " ".join(f"JOIN w w{k} ON w{k}.doc_id = w0.doc_id AND w{k}.i = w0.i + {k} AND w{k}.word = '{p}'" for k, p in enumerate(phrase.split()) if k)
        + f" WHERE w0.word = '{phrase.split()[0]}'"
        for phrase, label in PHRASES
    )
    return rf"""
WITH l AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '{WORD}') AS ws FROM documents),
w AS MATERIALIZED (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS i FROM l),
b AS ({base}),
bs AS (SELECT doc_id, count(*)::BIGINT AS n_base, min(i)::BIGINT AS first_word, max(i)::BIGINT AS last_word, list(DISTINCT label) AS names FROM b GROUP BY doc_id),
part(t, pos, word, rare, must) AS (VALUES {rows(parts)}),
tmpl(t, label, n, n_key, n_rare) AS (VALUES {rows(keys)}),
filed(word, t, pos) AS (VALUES {rows(filed)}),
prop AS (SELECT DISTINCT w.doc_id, f.t, w.i - f.pos AS at FROM w JOIN filed f USING (word)),
hit AS (SELECT p.doc_id, p.t, p.at, count(*) AS same, sum(part.rare) AS rare, sum(part.must) AS must
        FROM prop p JOIN part ON part.t = p.t JOIN w ON w.doc_id = p.doc_id AND w.i = p.at + part.pos AND w.word = part.word GROUP BY ALL),
ok AS (SELECT doc_id, label, same::DOUBLE / n AS score FROM hit JOIN tmpl USING (t) WHERE rare >= n_rare AND must = n_key AND same::DOUBLE / n >= {COVERAGE}),
os AS (SELECT doc_id, max(score) AS score, list(DISTINCT label) AS names FROM ok GROUP BY doc_id)
SELECT l.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
       array_to_string(list_sort(coalesce(bs.names, [])), ',') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(coalesce(bs.names, []), coalesce(os.names, [])))), ',') AS labels,
       coalesce(os.score, CASE WHEN n_base > 0 THEN 0.5::DOUBLE END, 0.0::DOUBLE)::DOUBLE AS score
FROM l LEFT JOIN bs USING (doc_id) LEFT JOIN os USING (doc_id)
"""
