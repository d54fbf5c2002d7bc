"""Line-first cleaning: lines that fail a rule are removed; a document that loses too much text is rejected.

Line rules, each on one \\n-split line with ``w`` words:

* punctuation: characters of ``[#*$%&<>]`` and runs of two or more ``!`` together number at least 0.4 ``w``;
* navigation: at least 3 ``|`` or ``»`` separators, numbering at least 0.25 ``w``;
* boilerplate: a fixed phrase (rights, cookies, subscriptions, scripts; in four languages) in a line of at most 40 words.

``kept`` is false where the base rules fail or where removed lines hold over ``max_loss`` of the words.

Defined results: a null or empty text has no words, so ``base_failed`` is true and the cleaned text is empty
(null stays null); white-space-only lines never fail; repeated rows are judged alike, each by itself; an empty
table gives an empty result; other columns pass through, clashing ones are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeseam.llm.columns import SPACE, let, size_long, space_words

SYMBOLS = "#*$%&|<>"
# Fixed phrases of the boilerplate rule.
BOILERPLATE = [
    "all rights reserved", "cookie policy", "uses cookies", "privacy policy", "terms of service", "terms of use", "subscribe to our", "sign up for our", "click here to", "enable javascript", "share this article", "follow us on", "skip to content", "back to top", "powered by",
    "alle rechte vorbehalten", "verwendet cookies", "nutzungsbedingungen", "newsletter abonnieren", "klicken sie hier", "folgen sie uns", "zum inhalt springen", "nach oben",
    "tous droits réservés", "utilise des cookies", "mentions légales", "conditions générales", "abonnez-vous", "cliquez ici", "suivez-nous", "aller au contenu", "haut de page",
    "todos los derechos reservados", "utiliza cookies", "aviso legal", "términos de uso", "suscríbete", "haga clic aquí", "síguenos", "saltar al contenido", "volver arriba",
]
MIN_WORDS, MAX_REPEAT_PCT, MAX_LOSS = 10, 20, 0.5
WINDOW = 5


def _removed(text: Column, pattern: str) -> Column:
    """How many characters ``pattern`` takes from ``text``."""
    return (F.length(text) - F.length(F.regexp_replace(text, pattern, ""))).cast("long")


def repeated_window_words(words: Column, n: int = WINDOW) -> Column:
    """How many words stand in a window of ``n`` words that the text holds twice or more, the first included.

    Windows are hashed to 64 bits.  Only a text in which hashes repeat is sorted; the words covered by the
    sorted starts s1 < s2 < ... are the sum of min(n, s(k+1) - s(k)), and n for the last.
    """

    def spread(h: Column) -> Column:
        pairs = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))

        def starts(p: Column) -> Column:
            same = lambda k, j: F.coalesce(F.get(p, k)["x"] == F.get(p, j)["x"], F.lit(False))
            return F.array_sort(F.transform(F.filter(F.sequence(F.lit(0), F.size(p) - 1), lambda k: same(k, k - 1) | same(k, k + 1)), lambda k: F.get(p, k)["i"]))

        covered = lambda s: F.aggregate(F.transform(s, lambda v, k: F.least(F.lit(n), F.coalesce(F.get(s, k + 1) - v, F.lit(n)))), F.lit(0).cast("long"), lambda a, v: a + v)
        return let(pairs, lambda p: let(starts(p), covered))

    hashes = F.transform(F.sequence(F.lit(0), F.size(words) - n), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(n)]))
    return F.when(F.size(words) < n, F.lit(0).cast("long")).otherwise(
        let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(spread(h)))
    )


def has_boilerplate(text: Column) -> Column:
    """Whether a text holds a fixed phrase; it is lower-cased once, and the phrases stay data in the plan."""
    phrases = F.array(*[F.lit(p) for p in BOILERPLATE])
    return let(F.lower(text), lambda low: F.exists(phrases, lambda p: F.contains(low, p)))


def line_fails(line: Column) -> Column:
    def judge(w: Column) -> Column:
        n = F.size(w)
        noise = _removed(line, r"[#*$%&<>]") + F.regexp_count(line, F.lit("!!+"))
        bars = _removed(line, r"[|»]")
        boiler = has_boilerplate(line)
        return (n > 0) & ((noise >= 0.4 * n) | ((bars >= 3) & (bars >= 0.25 * n)) | (boiler & (n <= 40)))

    return let(space_words(line), judge)


def line_quality(docs: DataFrame, text_col: str = "text", max_loss: float = MAX_LOSS) -> DataFrame:
    """``docs`` with base counts, n_lines_removed, n_words_removed, clean_text, base_failed and kept."""
    added = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines_removed", "n_words_removed", "clean_text", "base_failed", "kept"]
    keep = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in added]
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    filled = F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{SPACE}]"))
    counts = let(space_words(text), lambda w: F.struct(size_long(w).alias("n"), repeated_window_words(w).alias("r")))
    judged = let(
        F.transform(F.split(text, "\n"), lambda x: F.struct(x.alias("x"), line_fails(x).alias("f"))),
        lambda lines: F.struct(
            F.aggregate(F.filter(lines, lambda y: y["f"]), F.lit(0).cast("long"), lambda a, y: a + F.size(space_words(y["x"]))).alias("lost"),
            size_long(F.filter(lines, lambda y: y["f"])).alias("lines"),
            F.array_join(F.transform(F.filter(lines, lambda y: ~y["f"]), lambda y: y["x"]), "\n").alias("clean"),
        ),
    )
    # No line of a text without any of these can fail: such a text isn't taken apart.
    suspect = text.rlike(r"[#*$%&<>|»]|!!") | has_boilerplate(text)
    lost = F.col("__l.lost")
    return (
        docs.withColumn("__c", counts)
        .withColumn("__l", F.when(suspect, judged))
        .select(
            *keep,
            F.col("__c.n").alias("n_words"),
            F.length(F.regexp_replace(text, f"[{SPACE}]+", "")).cast("long").alias("word_chars"),
            _removed(text, r"[#*$%&|<>]").alias("n_symbols"),
            let(filled, lambda x: size_long(x) - size_long(F.array_distinct(x))).alias("n_dup_lines"),
            F.col("__c.r").alias("n_repeat_words"),
            F.coalesce(F.col("__l.lines"), F.lit(0).cast("long")).alias("n_lines_removed"),
            F.coalesce(lost, F.lit(0).cast("long")).alias("n_words_removed"),
            F.coalesce(F.col("__l.clean"), F.col(f"`{text_col}`")).alias("clean_text"),
        )
        .withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PCT * F.col("n_words")))
        .withColumn("kept", ~F.col("base_failed") & (F.col("n_words_removed") <= max_loss * F.col("n_words")))
    )
