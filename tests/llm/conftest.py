import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def corpus():
    """A hundred odd documents: prose, copies, near copies, shared lines, and every edge case."""
    rnd = random.Random(7)
    words = [f"{a}{b}{c}" for a in ("ka", "lo", "mi", "é", "T") for b in ("re", "su", "n") for c in ("t", "ra", "x")]
    prose = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    shared = [prose(12) for _ in range(3)]
    passage = prose(90)
    rows = []
    for i in range(70):
        lines = [prose(rnd.randint(3, 30)) for _ in range(rnd.randint(1, 6))]
        if i % 3 == 0:
            lines.insert(1, "  " + shared[0].upper() + "\t")
        if i % 5 == 0:
            lines += [shared[1], shared[1]]
        if i % 9 == 0:
            lines.append(passage)
        rows.append((i * 3, "\n".join(lines), "en", f"s{i % 4}", 0))
    base = prose(60)
    rows += [(1000 + i, base, "en", "s1", 0) for i in range(15)]
    rows += [(1100 + i, base + " " + prose(1), "en", "s1", 0) for i in range(8)]
    rows += [(2000, None, None, None, None), (2001, "", "en", "s2", 0), (2002, " \n\t ", "en", "s2", 0), (2003, "one", "en", "s2", 0), (2004, "two words", "en", None, 0)]
    rows += [(2005, prose(9000), "en", "s3", 0), (2006, "é\U0001f600 你好\n\n\nx", "en", "s3", 0), (2007, "same", "en", "s3", 0), (2007, "same", "en", "s3", 0), (None, "no id here", "en", "s0", 0)]
    rows += [(2010, "Licensed under the Apache License, Version 2.0.", "en", "s0", 0), (2011, "x MIT License y. released under the MIT license", "en", "s0", 0), (2012, "This work is licensed under the GNU General Public License, version 3.", "en", "s0", 0)]
    return rows


@pytest.fixture(scope="session")
def docs(spark, corpus):
    """The corpus as documents, with extra columns whose names clash with internal ones."""
    from pyspark.sql import functions as F

    frame = spark.createDataFrame(corpus, SCHEMA)
    return frame.withColumns({"rid": F.lit("extra"), "kept_text": F.lit(1), "w": F.lit(2), "fp": F.lit(3), "bucket": F.lit(4), "size": F.lit(5), "_id": F.lit(6), "pos": F.lit(7)})


@pytest.fixture(scope="session")
def none(docs):
    return docs.filter("doc_id = -5")
