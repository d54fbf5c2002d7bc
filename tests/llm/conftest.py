import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, items string, score string, rest string, h string, host string, `odd name` string"


def _doc(i, text, lang="en", source="src1"):
    return (i, text, lang, source, None if text is None else len(text), "x", "y", "z", "w", "q", "o")


def words(seed, n, size=6):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghijklmnop") for _ in range(size)) for _ in range(n))


LINE = "This very line is held by many documents of the fixture, again and again."


@pytest.fixture(scope="session")
def rows():
    """Nulls everywhere, empty and long texts, repeated rows, ties, near copies, columns with clashing names."""
    base = words(1, 200)
    out = [_doc(1, None), _doc(2, ""), _doc(3, " \t\n "), _doc(4, base), _doc(5, base), _doc(5, base), _doc(6, base.replace(base.split()[50], "changed")), (None, "no id " + words(2, 30), None, None, None, None, None, None, None, None, None)]
    out += [_doc(10 + i, f"{LINE.upper() if i % 2 else '  ' + LINE}\nown line number {i} {words(20 + i, 30)}\nshort", source=f"src{i % 3}") for i in range(7)]
    out += [_doc(30, words(3, 20_000)), _doc(31, "É " + words(4, 50), "fr"), _doc(32, "Licensed under the Apache License, Version 2.0. " + words(5, 40)), _doc(33, "All rights reserved. CC BY cc by. " + words(6, 20))]
    out += [_doc(40 + i, "a $$$ b %%% c &&& d *** e ### f $$$\n" * 3 + words(40 + i, 4)) for i in range(2)]
    out += [_doc(50 + i, words(60 + i, 60) + (" idiot moron scum " if i % 3 == 0 else ""), source="src9") for i in range(40)]
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
