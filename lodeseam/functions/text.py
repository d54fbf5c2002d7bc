"""Tokenizers and text functions as Column -> Column: no Python runs on executors.

ASCII tokenizers split first and lower-case each piece afterwards, so Unicode case folding never makes tokens.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodeseam.functions.words import BUILD_STOPS, CALL_NOISE, GREP_STOPS, QUERY_STOPS, SYMBOL_STOPS

# fixed values: where identifiers part, and what counts as an identifier
IDENT_SPLIT = r"[_\-.]|(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])"
IDENT = r"[A-Za-z_][A-Za-z0-9_]*"


def _clean(parts: Column, stops: list[str]) -> Column:
    low = F.transform(parts, lambda t: F.lower(F.trim(t)))
    return F.filter(low, lambda t: (F.length(t) > 1) & ~t.isin(stops))


def identifier_tokens(name: Column) -> Column:
    """``getUserById`` -> get, user, by, id; one-letter pieces and stop words dropped."""
    return _clean(F.split(F.coalesce(name, F.lit("")), IDENT_SPLIT), BUILD_STOPS)


def text_tokens(text: Column) -> Column:
    """Free text as it is indexed."""
    return _clean(F.split(F.coalesce(text, F.lit("")), "[^a-zA-Z0-9]+"), BUILD_STOPS)


def query_tokens(text: Column) -> Column:
    """Free text as it is searched: the lighter stop list."""
    return _clean(F.split(F.coalesce(text, F.lit("")), "[^a-zA-Z0-9]+"), QUERY_STOPS)


def flat_tokens(text: Column) -> Column:
    """Identifiers of a text, each taken apart."""
    return F.flatten(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({IDENT})"), 1), identifier_tokens))


def whole_identifiers(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({IDENT})"), 1), F.lower)


def grep_keywords(text: Column, limit: int = 20) -> Column:
    """The most frequent identifiers of three letters or more, ties by first place."""
    words = F.filter(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"([A-Za-z_][A-Za-z0-9_]{2,})"), 1), F.lower), lambda w: ~w.isin(GREP_STOPS))
    ranked = F.array_sort(F.transform(F.array_distinct(words), lambda w: F.struct((-F.size(F.filter(words, lambda x: x == w))).alias("n"), F.array_position(words, w).alias("p"), w.alias("w"))))
    return F.transform(F.slice(ranked, 1, limit), lambda s: s["w"])


def make_fqn(path: Column, *members: Column) -> Column:
    return F.concat(path, F.lit("::"), F.concat_ws(".", *members))


def file_of(fqn: Column) -> Column:
    return F.split_part(fqn, F.lit("::"), F.lit(1))


def member_of(fqn: Column) -> Column:
    return F.when(F.instr(fqn, "::") > 0, F.split_part(fqn, F.lit("::"), F.lit(-1))).otherwise(fqn)


def bare_name(fqn: Column) -> Column:
    """The last segment of a member."""
    return F.split_part(member_of(fqn), F.lit("."), F.lit(-1))


def return_type(signature: Column) -> Column:
    """After ``->``, or after the last ``:`` that follows the parameters; null if neither."""
    arrow = F.trim(F.regexp_replace(F.regexp_extract(signature, r"->\s*(.+)$", 1), r":\s*$", ""))
    colon = F.trim(F.regexp_extract(signature, r"\)\s*:\s*([^:{]+?)\s*\{?$", 1))
    return F.when(arrow != "", arrow).when(colon != "", colon)


def tier2(fqn: Column, signature: Column, docstring: Column) -> Column:
    """One line: place, signature, first line of the docstring."""
    return F.concat(fqn, F.lit(" | "), signature, F.when(F.coalesce(docstring, F.lit("")) != "", F.concat(F.lit(" | "), F.split_part(docstring, F.lit("\n"), F.lit(1)))).otherwise(""))


def tier3(fqn: Column, signature: Column) -> Column:
    """Name and return type alone."""
    kind = return_type(signature)
    return F.concat(fqn, F.when(kind.isNotNull(), F.concat(F.lit(" -> "), kind)).otherwise(""))


def quarter_tokens(text: Column) -> Column:
    """A token for four characters."""
    return F.floor(F.length(F.coalesce(text, F.lit(""))) / 4).cast("long")


def est_tokens(text: Column) -> Column:
    """As above, but one at least for a text that isn't empty."""
    n = F.length(F.coalesce(text, F.lit("")))
    return F.when(n == 0, F.lit(0)).otherwise(F.greatest(F.lit(1), F.floor(n / 4))).cast("long")


def embedding_text(fqn: Column, signature: Column, docstring: Column, keywords: Column) -> Column:
    return F.concat_ws(" ", member_of(fqn), signature, F.split_part(F.coalesce(docstring, F.lit("")), F.lit("\n"), F.lit(1)), F.array_join(F.slice(keywords, 1, 10), " "))


def humanised(name: Column) -> Column:
    return F.array_join(F.transform(F.split(name, IDENT_SPLIT), F.lower), " ")


def local_summary(fqn: Column, docstring: Column, params: Column, returns: Column, keywords: Column) -> Column:
    """The docstring's first line; else the name in words, up to 5 parameters, the return type, up to 8 keywords."""
    first = F.trim(F.split_part(F.coalesce(docstring, F.lit("")), F.lit("\n"), F.lit(1)))
    made = F.concat(
        humanised(bare_name(fqn)),
        F.when(F.size(params) > 0, F.concat(F.lit(" given "), F.array_join(F.slice(params, 1, 5), ", "))).otherwise(""),
        F.when(returns.isNotNull(), F.concat(F.lit(" returning "), returns)).otherwise(""),
        F.when(F.size(keywords) > 0, F.concat(F.lit("; uses "), F.array_join(F.slice(keywords, 1, 8), ", "))).otherwise(""),
    )
    return F.when(first != "", first).otherwise(made)


def chosen_summary(docstring: Column, existing: Column, heuristic: Column, min_words: int = 6) -> Column:
    """The docstring if it has enough words, else an existing summary that has, else the heuristic one."""
    enough = lambda c: F.when(F.size(F.filter(F.split(F.trim(F.coalesce(c, F.lit(""))), r"\s+"), lambda w: w != "")) >= min_words, c)
    return F.coalesce(enough(docstring), enough(existing), heuristic)


def short_hash(text: Column, n: int = 20) -> Column:
    return F.substring(F.sha1(text), 1, n)


def content_hash(model: Column, text: Column, cap: int = 2048) -> Column:
    """Key of an embedding: model, cap and the text that the cap leaves."""
    return short_hash(F.concat_ws("|", model, F.lit(str(cap)), F.substring(text, 1, cap)))


def is_test_path(path: Column) -> Column:
    p = F.lower(path)
    return p.rlike(r"(^|/)(tests?|__tests__|spec)/") | p.rlike(r"(^|/)test_[^/]*$") | p.rlike(r"(_test|\.test|\.spec)\.[a-z]+$") | p.rlike(r"(^|/)conftest\.py$")


def looks_symbolic(query: Column) -> Column:
    """A query that names symbols: one token, a pipe, or identifiers for over half of its tokens."""
    words = F.filter(F.split(F.trim(F.coalesce(query, F.lit(""))), r"\s+"), lambda w: w != "")
    named = F.filter(words, lambda w: w.rlike(r"^[A-Za-z_][A-Za-z0-9_]*([._][A-Za-z0-9_]+)+$|^[a-z]+[A-Z]|^[A-Z][a-z]+[A-Z]|_"))
    return (F.size(words) == 1) | F.coalesce(query, F.lit("")).contains("|") | (F.size(named) * 2 > F.size(words))


def issue_symbols(text: Column) -> Column:
    """Symbols that an issue names: frames, code spans, declarations and names in fences, errors, dotted paths."""
    t = F.coalesce(text, F.lit(""))
    every = lambda c, p: F.regexp_extract_all(c, F.lit(p), 1)
    fences = F.regexp_extract_all(t, F.lit(r"(```[\s\S]*?```)"), 1)
    inside = lambda p: F.flatten(F.transform(fences, lambda b: every(b, p)))
    # fixed values: the patterns of the kinds of symbols
    found = F.concat(
        every(t, r'File\s+"[^"]+",\s*line\s+\d+,\s*in\s+([A-Za-z_]\w+)'),
        every(t, r"`([A-Za-z_][\w.]{2,})`"),
        inside(r"\b(?:def|func|function|class)\s+([A-Za-z_]\w+)"),
        inside(r"\b([A-Za-z_]\w*(?:\.\w+)+|[A-Z][A-Za-z0-9]{2,})\b"),
        every(t, r"\b([A-Za-z_]\w*(?:Error|Exception|Warning))\b"),
        every(t, r"\b([A-Z][a-zA-Z0-9]+(?:\.[A-Za-z_]\w*)+)\b"),
        every(t, r"\bin\s+([a-z_]\w{3,})\b"),
    )
    return F.array_sort(F.filter(F.array_distinct(found), lambda s: (F.length(s) >= 3) & ~s.isin(SYMBOL_STOPS)))


def prose_only(text: Column) -> Column:
    """Without fenced code, tracebacks and frames; line ends made one kind."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), "\r\n", "\n")
    t = F.regexp_replace(t, r"(?s)```.*?(```|\z)", "")
    t = F.regexp_replace(t, r"(?m)^Traceback \(most recent call last\):\n(?:[ \t]+.*\n?)*", "")
    t = F.regexp_replace(t, r'(?m)^\s*File "[^"]+", line \d+.*\n?', "")
    return F.regexp_replace(F.regexp_replace(t, r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def import_names(statement: Column) -> Column:
    """The bare names that an import statement brings in."""
    body = F.regexp_replace(F.regexp_replace(statement, r"^\s*(from\s+\S+\s+)?import\s+", ""), r"[(){}]", "")
    return F.filter(F.transform(F.split(body, ","), lambda n: F.split_part(F.trim(F.regexp_replace(n, r"\s+as\s+\S+", "")), F.lit("."), F.lit(-1))), lambda n: n != "")


def seed_variants(path: Column) -> Column:
    """A path with and without the folders that sources are commonly kept in."""
    # fixed values: common source folders
    folders = ["src/", "cmd/", "pkg/", "internal/", "lib/", "dist/", "packages/"]
    bare = path
    for f in folders:
        bare = F.when(bare.startswith(f), F.substring(bare, len(f) + 1, 1 << 30)).otherwise(bare)
    return F.array_distinct(F.concat(F.array(path, bare), F.array(*[F.concat(F.lit(f), bare) for f in folders])))


def diff_shape(diff: Column) -> Column:
    lines = F.split(F.coalesce(diff, F.lit("")), "\n")
    n = lambda p: F.size(F.filter(lines, lambda x: x.rlike(p))).cast("long")
    return F.struct(n(r"^\+(?!\+\+)").alias("added"), n(r"^-(?!--)").alias("removed"), n("^@@").alias("hunks"), n("^diff --git ").alias("files"))


def kv_cache_bytes(tokens: Column, layers: Column, kv_heads: Column, head_dim: Column, dtype_bytes: Column) -> Column:
    return tokens * 2 * layers * kv_heads * head_dim * dtype_bytes


def imputed_cost(fresh: Column, cached: Column, out: Column, p_fresh: float, p_cached: float, p_out: float) -> Column:
    """Prices are for a million tokens."""
    return (fresh * p_fresh + cached * p_cached + out * p_out) / 1_000_000


def cosine(a: Column, b: Column) -> Column:
    """Dot product of unit vectors in double precision; null where their lengths differ."""
    pairs = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.when(F.size(a) == F.size(b), F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x))


def branch_complexity(body: Column) -> Column:
    """1 and the branch words of a body."""
    return (F.lit(1) + F.regexp_count(body, F.lit(r"\b(if|elif|else if|for|while|case|catch|except|and|or)\b|&&|\|\||\?"))).cast("int")


def body_keywords(body: Column, language: str = "python") -> Column:
    """Words of quoted literals, keys, raised errors, attributes and calls; in order, each once."""
    every = lambda p, g=1: F.regexp_extract_all(body, F.lit(p), g)
    pieces = lambda a, least=2: F.filter(F.flatten(F.transform(a, lambda v: F.split(F.lower(v), "[-_ ]"))), lambda p: (F.length(p) >= least) & ~p.isin(BUILD_STOPS))
    words = lambda a: F.filter(F.flatten(F.transform(a, lambda v: F.split(F.lower(v), "[^a-zA-Z0-9]+"))), lambda p: (F.length(p) > 2) & ~p.isin(BUILD_STOPS))
    names = lambda a, least=1: F.flatten(F.transform(F.filter(a, lambda v: (F.length(v) >= least) & ~F.lower(v).isin(BUILD_STOPS)), identifier_tokens))
    # fixed values: the patterns of each language
    parts = [
        pieces(F.filter(every(r"""["']([A-Za-z][A-Za-z0-9_-]{2,}(?:[- ][A-Za-z0-9_-]+)*)["']"""), lambda v: ~F.lower(v).isin(BUILD_STOPS))),
        pieces(every(r"""\[\s*["']([A-Za-z][A-Za-z0-9_-]+)["']\s*\]""")),
    ]
    if language == "python":
        parts += [names(every(r"raise\s+([A-Z][a-zA-Z]+)")), names(every(r"self\.([a-z_][a-z_0-9]*)"), 3)]
    elif language == "go":
        parts += [words(every(r'(?:fmt\.Errorf|errors\.New|errors\.Wrap)\s*\(\s*"([^"]+)"')), names(F.flatten(F.transform(every(r"\b([a-z][a-zA-Z0-9]*\.\s*[A-Z][a-zA-Z0-9]+)"), lambda v: F.split(v, r"\.\s*")))), words(every(r'panic\s*\(\s*"([^"]+)"'))]
    elif language in ("typescript", "javascript", "tsx", "jsx"):
        parts += [
            names(F.flatten(F.transform(every(r"this\.([a-zA-Z_][a-zA-Z0-9_]*(?:\.[a-zA-Z_][a-zA-Z0-9_]*)?)"), lambda v: F.split(v, r"\."))), 2),
            names(every(r"throw\s+new\s+([A-Z][a-zA-Z]+)")),
            names(F.flatten(F.transform(every(r"\$\{([a-zA-Z_][a-zA-Z0-9_.]+)\}"), lambda v: F.split(v, r"\."))), 2),
            names(every(r"\b(querySelector|getElementById|createElement|addEventListener|removeEventListener|dispatch|emit|subscribe)\b")),
            F.filter(F.transform(every(r"""(?:require|import)\s*\(\s*["']([^"'/][^"']*)["')]"""), lambda m: F.lower(F.split_part(m, F.lit("/"), F.lit(-1)))), lambda m: (F.length(m) > 1) & ~m.isin(BUILD_STOPS)),
        ]
    parts.append(names(F.filter(every(r"\b([a-zA-Z_][a-zA-Z0-9_]{2,})\s*\("), lambda v: ~F.lower(v).isin(CALL_NOISE))))
    return F.array_distinct(F.concat(*parts))
