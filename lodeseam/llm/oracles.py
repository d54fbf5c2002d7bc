"""DuckDB twins of this subpackage's queries, for those that SQL can express."""

from __future__ import annotations

from lodeseam.llm import license_index, quality_lines, source_mix, url_rules

_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_WORD = r"[^\x20\x09-\x0D]+"
#: A-Z alone are lower-cased.
_LOW = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _alnum_words(text: str) -> str:
    return f"regexp_extract_all({_LOW.format(text)}, '{_ALNUM}')"


_BOILER = "|".join(quality_lines.BOILERPLATE)
OP5 = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, regexp_extract_all(text, '{_WORD}') AS ws FROM d),
pos AS (SELECT rid, unnest(range(1, len(ws) - 3)) AS i, ws FROM w WHERE len(ws) >= 5),
win AS (SELECT rid, i, array_to_string(list_slice(ws, i, i + 4), ' ') AS x FROM pos),
dup AS (SELECT rid, x FROM win GROUP BY rid, x HAVING count(*) > 1),
cov AS (SELECT rid, count(DISTINCT k) AS n FROM (SELECT win.rid, unnest(range(i, i + 5)) AS k FROM win JOIN dup USING (rid, x)) GROUP BY rid),
ln AS (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM d),
lc AS (SELECT rid, line, len(regexp_extract_all(line, '{_WORD}')) AS n, len(regexp_extract_all(line, '[#*$%&<>]')) + len(regexp_extract_all(line, '!!+')) AS noise, len(regexp_extract_all(line, '[|»]')) AS bars, regexp_matches(lower(line), '{_BOILER}') AS boiler FROM ln),
lf AS (SELECT *, n > 0 AND (noise >= 0.4 * n OR (bars >= 3 AND bars >= 0.25 * n) OR (boiler AND n <= 40)) AS fails FROM lc),
la AS (SELECT rid, count(*) FILTER (n > 0) - count(DISTINCT line) FILTER (n > 0) AS dups, count(*) FILTER (fails) AS gone, coalesce(sum(n) FILTER (fails), 0) AS lost FROM lf GROUP BY rid),
b AS (SELECT doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, dups::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words, gone::BIGINT AS n_lines_removed, lost::BIGINT AS n_words_removed
  FROM d JOIN w USING (rid) JOIN la USING (rid) LEFT JOIN cov USING (rid))
SELECT *, n_words < {quality_lines.MIN_WORDS} OR 100 * n_repeat_words > {quality_lines.MAX_REPEAT_PCT} * n_words AS base_failed,
  NOT (n_words < {quality_lines.MIN_WORDS} OR 100 * n_repeat_words > {quality_lines.MAX_REPEAT_PCT} * n_words) AND n_words_removed <= {quality_lines.MAX_LOSS} * n_words AS kept FROM b"""

OP6 = rf"""
WITH it AS (SELECT item_id::VARCHAR AS item, {_alnum_words("coalesce(text, '')")} AS ws FROM benchmark),
iw AS (SELECT DISTINCT item, least(10, len(ws)) AS size, array_to_string(list_slice(ws, i, i + least(10, len(ws)) - 1), ' ') AS x FROM (SELECT *, unnest(range(1, greatest(1, len(ws) - 9) + 1)) AS i FROM it WHERE len(ws) > 0)),
d AS (SELECT row_number() OVER () AS rid, doc_id, {_alnum_words("coalesce(text, '')")} AS ws FROM documents),
sizes AS (SELECT DISTINCT size FROM iw),
dw AS (SELECT rid, size, i, array_to_string(list_slice(ws, i, i + size - 1), ' ') AS x FROM (SELECT rid, ws, size, unnest(range(1, len(ws) - size + 2)) AS i FROM d, sizes WHERE len(ws) >= size)),
hit AS (SELECT rid, i, dw.size, item FROM dw JOIN iw ON dw.x = iw.x AND dw.size = iw.size),
hw AS (SELECT rid, count(DISTINCT k) AS n FROM (SELECT rid, unnest(range(i, i + size)) AS k FROM hit) GROUP BY rid),
hi AS (SELECT rid, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item FROM hit) GROUP BY rid)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(hw.n, 0)::BIGINT AS n_hit, coalesce(hi.n, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(hw.n, 0) > 0 AS contaminated
FROM d LEFT JOIN hw USING (rid) LEFT JOIN hi USING (rid)"""

_RULES = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in url_rules.RULES)
OP7 = rf"""
WITH r AS (SELECT * FROM (VALUES {_RULES}) t(v, rh, rp)),
u AS (SELECT row_number() OVER () AS rid, page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
p AS (SELECT rid, page_id, coalesce({_LOW.format("regexp_extract(rest, '^[^/?#]*')")}, '') AS host, coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM u),
m AS (SELECT rid, rh || rp AS rule, v, row_number() OVER (PARTITION BY rid ORDER BY length(rh) + length(rp) DESC, length(rh) DESC, v DESC) AS k FROM p JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM p LEFT JOIN (SELECT * FROM m WHERE k = 1) USING (rid)"""

_TEMPLATES = ", ".join(f"({t}, '{label}', {i}, '{w}', {str(a <= i < z).lower()}, {len(words)}, {z - a})" for t, (label, words, a, z) in enumerate(license_index._spans()) for i, w in enumerate(words))
_PHRASES = ", ".join(f"('{p}', '{label}', {len(p.split())})" for p, label in license_index.BASE_PHRASES)
OP8 = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_alnum_words("coalesce(text, '')")} AS ws FROM documents),
tw AS (SELECT rid, unnest(ws) AS w, generate_subscripts(ws, 1) - 1 AS i FROM d),
tp AS (SELECT * FROM (VALUES {_TEMPLATES}) t(t, label, p, w, must, n, nm)),
df AS (SELECT w, count(DISTINCT rid) AS df FROM tw WHERE w IN (SELECT w FROM tp) GROUP BY w),
idf AS (SELECT v.w, round(ln((1 + (SELECT count(*) FROM d))::DOUBLE / (1 + coalesce(df.df, 0))) + 1, 6) AS idf FROM (SELECT DISTINCT w FROM tp) v LEFT JOIN df USING (w)),
tot AS (SELECT t, round(sum(idf), 6) AS total FROM tp JOIN idf USING (w) GROUP BY t),
c AS (SELECT rid, tp.t, label, i - p AS b, sum(idf) AS s, count(*) FILTER (must) AS met, any_value(nm) AS nm FROM tw JOIN tp USING (w) JOIN idf USING (w) GROUP BY rid, tp.t, label, i - p),
ok AS (SELECT rid, label, round(s / total, 6) AS cover FROM c JOIN tot USING (t) WHERE met = nm AND round(s / total, 6) >= {license_index.MIN_COVER}),
ph AS (SELECT * FROM (VALUES {_PHRASES}) t(phrase, label, k)),
bh AS (SELECT d.rid, ph.label, i - 1 AS i FROM d, ph, unnest(range(1, len(ws) + 1)) u(i) WHERE contains(array_to_string(ws, ' '), phrase) AND array_to_string(list_slice(ws, i, i + k - 1), ' ') = phrase),
bs AS (SELECT rid, count(*) AS n, min(i) AS f, max(i) AS l, string_agg(DISTINCT label, ',' ORDER BY label) AS labs FROM bh GROUP BY rid),
al AS (SELECT rid, string_agg(DISTINCT label, ',' ORDER BY label) AS labs FROM (SELECT rid, label FROM ok UNION SELECT rid, label FROM bh) GROUP BY rid),
mx AS (SELECT rid, max(cover) AS cover FROM ok GROUP BY rid)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(bs.n, 0)::BIGINT AS n_base, bs.f::BIGINT AS first_word, bs.l::BIGINT AS last_word, coalesce(bs.labs, '') AS base_labels, coalesce(al.labs, '') AS labels, CASE WHEN bs.n > 0 THEN 1.0::DOUBLE ELSE coalesce(mx.cover, 0.0::DOUBLE) END AS score
FROM d LEFT JOIN bs USING (rid) LEFT JOIN al USING (rid) LEFT JOIN mx USING (rid)"""

OP10 = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT rid, doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM d),
k AS (SELECT *, {_LOW.format("trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} AS key FROM l),
o AS (SELECT key, max(doc_id) AS top FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT rid) >= 5),
f AS (SELECT rid, line, i, top IS NOT NULL AND top <> doc_id AS gone FROM k LEFT JOIN o USING (key))
SELECT d.doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM f JOIN d USING (rid) GROUP BY d.rid, d.doc_id"""


def _level(i: int, levels: tuple[str, ...]) -> str:
    """Children of level ``i`` with their shares; see source_mix.deal."""
    path, up = ", ".join(levels[: i + 1]), ", ".join(levels[:i])
    weight = [f"coalesce(map_extract({{{', '.join(f'{k!r}: {v}::DOUBLE' for k, v in w.items())}}}::MAP(VARCHAR, DOUBLE), {level})[1], 0.1)::DOUBLE" for level, w in (("domain", source_mix.DOMAIN_WEIGHTS), ("lang", source_mix.LANG_WEIGHTS))]
    weight = [w.replace("{'", "MAP {'").replace("::MAP(VARCHAR, DOUBLE)", "") for w in weight] + ["1.0::DOUBLE"]
    part = f"PARTITION BY {up} " if up else ""
    parent = "(SELECT total FROM tt)" if i == 0 else "b.share"
    join = "" if i == 0 else f"JOIN s{i - 1} b USING ({up})"
    win = f"({part}ORDER BY capacity / weight, {levels[i]}"
    return f"""
n{i} AS (SELECT c.*, {weight[i]} AS weight, {parent} AS budget FROM (SELECT {path}, sum(capacity)::BIGINT AS capacity FROM tree GROUP BY {path}) c {join}),
v{i} AS (SELECT *, (budget - coalesce(sum(capacity) OVER {win} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE / sum(weight) OVER {win} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM n{i}),
x{i} AS (SELECT *, arg_min(level, capacity / weight) FILTER (capacity >= level * weight) OVER ({part.strip()}) AS cut FROM v{i}),
s{i} AS (SELECT {path}, floor(least(capacity::DOUBLE, coalesce(cut * weight, capacity::DOUBLE)) + 1e-6::DOUBLE)::BIGINT AS share FROM x{i})"""


_TOK = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT"
OP4 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce({str(source_mix.DOMAINS)}[coalesce(try_cast(nullif(regexp_extract(source, '(\d{{1,9}})$', 1), '') AS INT), 0) % 4 + 1], '(null)') AS domain, coalesce(lang, '(null)') AS lang, coalesce(source, '(null)') AS source, {_TOK} AS n_tokens FROM documents),
tree AS (SELECT domain, lang, source, sum(n_tokens)::BIGINT AS tokens, sum(n_tokens)::BIGINT * {source_mix.MAX_EPOCHS} AS capacity FROM d GROUP BY ALL),
tt AS (SELECT least(floor(sum(tokens)::DOUBLE * {source_mix.SHARE}::DOUBLE)::BIGINT, sum(tokens)::BIGINT * {source_mix.MAX_EPOCHS}) AS total FROM tree),{_level(0, source_mix.LEVELS)},{_level(1, source_mix.LEVELS)},{_level(2, source_mix.LEVELS)},
lb AS (SELECT domain, lang, source, s2.share // tokens AS whole, s2.share % tokens AS rest FROM s2 JOIN tree USING (domain, lang, source) WHERE tokens > 0),
h AS (SELECT d.*, whole, rest, md5('{source_mix.SEED}:' || whole || ':' || coalesce(doc_id::VARCHAR, '')) AS h FROM d JOIN lb USING (domain, lang, source)),
c AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY h, n_tokens RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM h),
e AS (SELECT doc_id, domain, lang, source, n_tokens, unnest(range(0, whole)) AS epoch FROM c UNION ALL SELECT doc_id, domain, lang, source, n_tokens, whole FROM c WHERE rest > 0 AND upto <= rest)
SELECT doc_id, domain, lang, source, epoch::BIGINT AS epoch, n_tokens FROM e"""
OP4 = OP4.replace("WITH RECURSIVE", "WITH")

ORACLE: dict[str, str] = {"op4_mix": OP4, "op5_quality": OP5, "op6_decontaminate": OP6, "op7_urls": OP7, "op8_licenses": OP8, "op10_lines": OP10}
