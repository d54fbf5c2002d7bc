"""License scans: a positional rare-token index over licence templates.

Templates are short licence notices with a mandatory key phrase each (a run of their words).  Every template
word's IDF is taken over all documents.  The index holds, for each template, its ``ANCHORS`` key-phrase words of
highest IDF with their positions.  A file's words are looked up in it; a posting and a place in the file give the
place where the template would begin.  The places that the anchors of a template give are intersected: one candidate
for each (template, beginning) on which all anchors agree.  A candidate counts if every word of the key phrase stands
in its place, and the words in place hold at least ``MIN_COVER`` of the template's IDF.  The index and the templates are
data in the plan, looked up by number, so the plan's expressions don't grow with the library; each file is looked up in
its own row, and nothing is shuffled but the IDF counts.

Base labels come from fixed phrases whose words stand consecutively, and always stay.

Defined results: a null or empty text has no words, no labels and score 0; repeated rows are scanned alike, each
by itself; an empty table gives an empty result; other columns pass through, clashing ones are replaced.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeseam.llm.columns import let, size_long

BASE_PHRASES = [("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")]
# Licence notices: label, words, key phrase.
TEMPLATES = [
    ("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2"),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at", "except in compliance with the license"),
    ("mit", "released under the mit license", "mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", "permission is hereby granted free of charge"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "use copy modify and or distribute this software for any purpose"),
    ("isc", "released under the isc license", "isc license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use in source and binary forms"),
    ("bsd-3-clause", "licensed under the bsd 3 clause license", "bsd 3 clause"),
    ("bsd-2-clause", "licensed under the bsd 2 clause license", "bsd 2 clause"),
    ("gpl-3.0", "licensed under the gnu general public license version 3", "gnu general public license version 3"),
    ("gpl-3.0", "licensed under the gnu general public license v3 0", "gnu general public license v3"),
    ("gpl-2.0", "licensed under the gnu general public license version 2", "gnu general public license version 2"),
    ("gpl-2.0", "licensed under the gnu general public license v2 0", "gnu general public license v2"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl", "under the terms of the gnu lesser general public license", "gnu lesser general public license"),
    ("agpl", "under the terms of the gnu affero general public license", "gnu affero general public license"),
    ("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", "mozilla public license v 2 0"),
    ("mpl-2.0", "licensed under the mozilla public license version 2 0", "mozilla public license version 2"),
    ("epl-2.0", "made available under the terms of the eclipse public license 2 0", "eclipse public license 2"),
    ("epl-2.0", "made available under the terms of the eclipse public license v 2 0", "eclipse public license v 2"),
    ("epl-1.0", "made available under the terms of the eclipse public license v1 0", "eclipse public license v1"),
    ("cddl-1.0", "subject to the terms of the common development and distribution license", "common development and distribution license"),
    ("eupl-1.2", "licensed under the european union public licence", "european union public licence"),
    ("artistic-2.0", "licensed under the artistic license 2 0", "artistic license 2"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable", "without any express or implied warranty in no event will the authors"),
    ("boost-1.0", "distributed under the boost software license version 1 0", "boost software license"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
    ("wtfpl", "do what the fuck you want to public license", "what the fuck you want to public license"),
    ("postgresql", "released under the postgresql license", "postgresql license"),
    ("python-2.0", "python software foundation license version 2", "python software foundation license"),
    ("cc0-1.0", "released under cc0 1 0 universal public domain dedication", "cc0 1 0 universal"),
    ("public-domain", "this work is dedicated to the public domain", "dedicated to the public domain"),
    ("ofl-1.1", "licensed under the sil open font license version 1 1", "sil open font license"),
    ("odbl-1.0", "made available under the open database license", "open database license"),
    ("gfdl", "under the terms of the gnu free documentation license", "gnu free documentation license"),
    ("cc-by-nc-nd-4.0", "licensed under cc by nc nd 4 0", "cc by nc nd 4 0"),
    ("cc-by-nc-sa-4.0", "licensed under cc by nc sa 4 0", "cc by nc sa 4 0"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", "cc by nc 4 0"),
    ("cc-by-nd-4.0", "licensed under cc by nd 4 0", "cc by nd 4 0"),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", "cc by sa 4 0"),
    ("cc-by-sa-3.0", "licensed under cc by sa 3 0", "cc by sa 3 0"),
    ("cc-by-4.0", "licensed under cc by 4 0", "cc by 4 0"),
    ("cc-by-4.0", "licensed under a creative commons attribution 4 0 international license", "creative commons attribution 4 0"),
    ("cc-by-sa-4.0", "licensed under a creative commons attribution sharealike 4 0 international license", "creative commons attribution sharealike 4 0"),
]
ANCHORS, MIN_COVER = 3, 0.6
_SPLIT = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def notice_words(text: Column) -> Column:
    """The words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lower-cased.

    ``lower`` is used for speed; the Kelvin sign, the one other character that it would turn into an ASCII
    letter, is kept by a detour, and other letters never meet an ASCII word.
    """
    t = F.coalesce(text, F.lit(""))
    t = F.when(t.contains("K"), F.regexp_replace(t, "K", "àà")).otherwise(t)
    return F.filter(F.split(F.lower(t), _SPLIT), lambda w: w != "")


def _spans() -> list[tuple[str, list[str], int, int]]:
    """Label, words, and the key phrase's first and past-last position."""
    out = []
    for label, text, key in TEMPLATES:
        words, k = text.split(), key.split()
        at = next(i for i in range(len(words)) if words[i : i + len(k)] == k)
        out.append((label, words, at, at + len(k)))
    return out


def word_idf(docs: DataFrame, text_col: str = "text") -> dict[str, float]:
    """IDF over all documents of every word that a template has: as many rows as the templates have words."""
    vocab = sorted({w for _, words, _, _ in _spans() for w in words})
    seen = docs.select(F.array_distinct(F.filter(notice_words(F.col(f"`{text_col}`")), lambda w: w.isin(vocab))).alias("ws"))
    counts = seen.select(F.explode(F.when(F.size("ws") > 0, F.concat("ws", F.array(F.lit("")))).otherwise(F.array(F.lit("")))).alias("w")).groupBy("w").count()
    df = {r["w"]: r["count"] for r in counts.collect()}
    n = df.get("", 0)  # the empty word is given to each document once
    return {w: round(math.log((1 + n) / (1 + df.get(w, 0))) + 1.0, 6) for w in vocab}


def build_index(docs: DataFrame, text_col: str = "text") -> tuple[Column, Column, list[str]]:
    """The index as columns: postings by word, the templates, and the words that have postings.

    Each template gives ``ANCHORS`` postings (template, position, which anchor): its key phrase's words of highest IDF,
    the last one again where the phrase has fewer.  The index is as large as the library, whatever the documents.
    """
    idf = word_idf(docs, text_col)
    postings: dict[str, list[tuple[int, int, int]]] = {}
    templates = []
    for t, (label, words, a, z) in enumerate(_spans()):
        rare = sorted(range(a, z), key=lambda p: (-idf[words[p]], p))[:ANCHORS]
        for k in range(ANCHORS):
            p = rare[min(k, len(rare) - 1)]
            postings.setdefault(words[p], []).append((t, p, k))
        templates.append((label, words, [idf[w] for w in words], a, z, round(sum(idf[w] for w in words), 6)))
    anchors = sorted(postings)
    sql = lambda x: "'" + x.replace("'", "''") + "'" if isinstance(x, str) else f"{x}D" if isinstance(x, float) else "array(" + ", ".join(map(sql, x)) + ")" if isinstance(x, list) else str(x)
    rows = lambda xs, names: "array(" + ", ".join("named_struct(" + ", ".join(f"'{n}', {sql(v)}" for n, v in zip(names, x, strict=True)) + ")" for x in xs) + ")"
    posting = F.expr("map_from_arrays(" + sql(anchors) + ", array(" + ", ".join(rows(postings[w], "tpk") for w in anchors) + "))")
    return posting, F.expr(rows(templates, ["label", "words", "weights", "first", "past", "total"])), anchors


def scan_licenses(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with n_words, n_base, first_word, last_word, base_labels, labels and score."""
    posting, templates, anchors = build_index(docs, text_col)

    def cover(words: Column, t: Column, b: Column) -> Column:
        """The part of the IDF of template ``t`` that stands in place from word ``b`` on; null without its key phrase."""
        there = lambda p: F.coalesce(F.get(words, b + p) == F.get(t["words"], p), F.lit(False))
        key = F.forall(F.sequence(t["first"], t["past"] - 1), there)
        weight = F.aggregate(F.sequence(F.lit(0), F.size(t["words"]) - 1), F.lit(0.0), lambda s, p: s + F.when(there(p), F.get(t["weights"], p)).otherwise(0.0))
        share = F.round(weight / t["total"], 6)
        return F.when(key & (share >= MIN_COVER), share)

    def found(words: Column) -> Column:
        hits = F.filter(F.transform(words, lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda h: h["w"].isin(anchors))
        places = F.flatten(F.transform(hits, lambda h: F.transform(posting[h["w"]], lambda p: F.struct(p["k"].alias("k"), p["t"].alias("t"), (h["i"] - p["p"]).alias("b")))))
        begins = lambda all_, k: F.transform(F.filter(all_, lambda x: x["k"] == k), lambda x: F.struct(x["t"].alias("t"), x["b"].alias("b")))
        # A template may begin where all its anchors say so.
        both = let(places, lambda x: reduce(F.array_intersect, [begins(x, k) for k in range(ANCHORS)]))
        judged = F.transform(both, lambda c: let(F.get(templates, c["t"]), lambda t: F.struct(t["label"].alias("label"), cover(words, t, c["b"]).alias("cover"))))
        return F.filter(judged, lambda c: c["cover"].isNotNull())

    # Words joined by two spaces between single ones: each word has a space of its own on either side.
    line = F.concat(F.lit(" "), F.array_join("__w", "  "), F.lit(" "))
    before = lambda s: ((F.length(s) - F.length(F.replace(s, F.lit("  "), F.lit(" ")))) + (F.length(s) > 0).cast("int")).cast("long")
    bases = []
    for phrase, label in BASE_PHRASES:
        mark = " " + "  ".join(phrase.split()) + " "
        here = lambda m=mark, lab=label: let(
            F.split("__s", m),
            lambda parts: F.struct(
                F.lit(lab).alias("label"),
                (F.size(parts) - 1).cast("long").alias("n"),
                before(F.get(parts, F.lit(0))).alias("first"),
                (F.size("__w") - before_tail(F.get(parts, F.size(parts) - 1)) - len(m.split())).cast("long").alias("last"),
            ),
        )
        bases.append(F.when(F.col("__s").contains(mark), here()))
    added = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    keep = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in added]
    b = F.col("__b")
    return (
        docs.withColumn("__w", notice_words(F.col(f"`{text_col}`")))
        .withColumn("__s", line)
        .withColumn("__b", F.array_compact(F.array(*bases)))
        .withColumn("__m", F.when(F.arrays_overlap("__w", F.array(*[F.lit(a) for a in anchors])), found(F.col("__w"))).otherwise(F.array().cast("array<struct<label:string,cover:double>>")))
        .select(
            *keep,
            size_long(F.col("__w")).alias("n_words"),
            F.aggregate(b, F.lit(0).cast("long"), lambda a, x: a + x["n"]).alias("n_base"),
            F.array_min(F.transform(b, lambda x: x["first"])).alias("first_word"),
            F.array_max(F.transform(b, lambda x: x["last"])).alias("last_word"),
            F.array_join(F.array_sort(F.array_distinct(F.transform(b, lambda x: x["label"]))), ",").alias("base_labels"),
            F.array_join(F.array_sort(F.array_distinct(F.concat(F.transform(b, lambda x: x["label"]), F.transform("__m", lambda x: x["label"])))), ",").alias("labels"),
            F.when(F.size(b) > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max(F.transform("__m", lambda x: x["cover"])), F.lit(0.0))).alias("score"),
        )
    )


def before_tail(s: Column) -> Column:
    """How many words the rest of the joined line after a phrase holds."""
    return F.when(F.length(s) == 0, F.lit(0)).otherwise(F.length(s) - F.length(F.replace(s, F.lit("  "), F.lit(" "))) + 1)
