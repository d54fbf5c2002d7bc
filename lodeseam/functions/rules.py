"""Rule classifiers and routers as columns; queries are rows, so each is a projection."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeseam.functions.words import FAMILY_SECTIONS, HARD_SIGNALS, HARD_STOPS, MODES, PROMPT_FAMILIES, QUICK_WORDS, SOFT_STOPS, TASK_KEYWORDS

# fixed values: patterns of paths, errors, line numbers and relational questions
PATH = r"([A-Za-z0-9_./\\-]+\.(?:py|js|tsx|ts|jsx|mjs|cjs|java|go|rs|cpp|cs|rb|php|json|yaml|yml|toml|md|txt|cfg|ini|env))"
ERRORS = [r"(?i)(?:Error|Exception|Traceback)[\s:]+(.+)", r"(?i)traceback.*?:\s*(.+)", r'"([^"]*(?:Error|Exception)[^"]*)"']
LINE = r"(?:line\s+|L|:)(\d+)"
RELATION = r"(?i)\b(calls?|caller|callers|callee|invoke[sd]?|use[sd]?|used by|depend\w*|reference\w*|refer|impact\w*|affect\w*|blast radius|propagat\w*|downstream|upstream|trace\w*|ripple)\b"


def has_any(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(w) for w in words])


def intent_paths(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(PATH), 1), lambda p: F.replace(p, F.lit("\\"), F.lit("/")))


def error_message(text: Column) -> Column:
    """The first of three patterns that matches, 200 characters; null if none."""
    found = [F.nullif(F.substring(F.trim(F.regexp_extract(F.coalesce(text, F.lit("")), p, 1)), 1, 200), F.lit("")) for p in ERRORS]
    return F.coalesce(*found)


def line_number(text: Column) -> Column:
    return F.nullif(F.regexp_extract(F.coalesce(text, F.lit("")), LINE, 1), F.lit("")).cast("long")


def candidate_names(text: Column) -> Column:
    """Identifiers that may be entities; common domain words drop out once a path is named."""
    words = F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\b([a-zA-Z_]\w{2,})\b"), 1))
    hard = F.filter(words, lambda w: ~F.lower(w).isin(HARD_STOPS))
    return F.when(F.size(intent_paths(text)) > 0, F.filter(hard, lambda w: ~F.lower(w).isin(SOFT_STOPS))).otherwise(hard)


def task_scores(text: Column) -> Column:
    """Score of each task, as structs ordered by priority."""
    low = F.lower(F.coalesce(text, F.lit("")))
    err, line = error_message(text).isNotNull().cast("int"), line_number(text).isNotNull().cast("int")
    extra = {"debug": err * 3.0 + line * 1.0, "edit": line * 1.0, "explain": low.contains("?").cast("int") * 1.5}
    out = []
    for i, (task, words) in enumerate(TASK_KEYWORDS.items()):
        score = sum((low.contains(w).cast("int") for w in words), F.lit(0)) + extra.get(task, F.lit(0.0))
        out.append(F.struct(score.cast("double").alias("score"), F.lit(-i).alias("prio"), F.lit(task).alias("task")))
    return F.array(*out)


def task_type(text: Column) -> Column:
    best = F.array_max(task_scores(text))
    return F.when(best["score"] == 0, "edit").otherwise(best["task"])


def hard_signal(text: Column, has_entities: Column) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    rule = None
    for mode, words in HARD_SIGNALS:
        hit = has_any(low, words) & (~has_entities if mode == "architecture" else F.lit(True))
        rule = F.when(hit, mode) if rule is None else rule.when(hit, mode)
    return rule


def query_mode(text: Column, has_entities: Column, override: Column | None = None) -> Column:
    """Override, then hard signals, then the task."""
    task, low = task_type(text), F.lower(F.coalesce(text, F.lit("")))
    by_task = (
        F.when(task == "debug", F.when(has_entities, "debug_targeted").otherwise("debug_investigate"))
        .when(task == "create", F.when(has_entities, "build_guided").otherwise("build_greenfield"))
        .when(task == "edit", F.when(has_entities, "debug_targeted").otherwise("build_guided"))
        .when((task == "explain") & ~has_entities & has_any(low, ["architecture", "design", "system"]), "architecture")
        .otherwise(task)
    )
    named = F.lower(F.trim(override)) if override is not None else F.lit(None).cast("string")
    return F.coalesce(F.when(named.isin([m[0] for m in MODES]), named), hard_signal(text, has_entities), by_task)


def mode_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(MODES, "mode string, tier string, budget int, direction string, blast_depth int, dep_depth int, load_tests boolean, modifiers string, complexity double")


def mode_value(mode: Column, field: int, default: object = None) -> Column:
    """A field of the mode table as a column."""
    out = None
    for m in MODES:
        out = F.when(mode == m[0], F.lit(m[field])) if out is None else out.when(mode == m[0], F.lit(m[field]))
    return out.otherwise(F.lit(default))


def modifiers(text: Column, mode: Column, level: Column) -> Column:
    """The mode's modifiers; low confidence adds one, a quick question leaves MINIMAL alone; two at most."""
    own = F.filter(F.split(mode_value(mode, 7, ""), ","), lambda m: m != "")
    more = F.when((level == "LOW") & ~F.array_contains(own, "THINK_ALOUD"), F.concat(own, F.array(F.lit("THINK_ALOUD")))).otherwise(own)
    return F.slice(F.when(has_any(F.lower(text), QUICK_WORDS), F.array(F.lit("MINIMAL"))).otherwise(more), 1, 2)


# fixed values: older names of the modes
OLD_TYPES = {"retrieval_fast": "general", "debug_targeted": "code_fix", "debug_investigate": "debug_investigate", "build_guided": "new_feature", "build_greenfield": "new_feature", "refactor": "refactor", "explain": "debug_investigate", "architecture": "planning", "review": "summary", "test": "new_feature", "document": "general", "migrate": "refactor"}
OLD_MODES = {"retrieval_fast": "fast", "debug_targeted": "fast", "debug_investigate": "standard", "build_guided": "standard", "build_greenfield": "deep", "refactor": "standard", "explain": "standard", "architecture": "planning", "review": "review", "test": "standard", "document": "fast", "migrate": "deep"}


def _mapped(c: Column, table: dict[str, str], default: str) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[c], F.lit(default))


def old_type(mode: Column) -> Column:
    return _mapped(mode, OLD_TYPES, "general")


def old_mode(mode: Column, level: Column) -> Column:
    return F.when(level == "MISS", "pass_through").otherwise(_mapped(mode, OLD_MODES, "standard"))


def complexity_score(mode: Column, level: Column, candidates: Column, tokens: Column, slm_used: Column) -> Column:
    """Base of the mode, shifted by confidence, width and size; modes of the large tier have a floor."""
    s = mode_value(mode, 8, 0.5)
    s = F.when(level == "LOW", s + 0.10).when(level == "MISS", F.greatest(s - 0.15, F.lit(0.05))).when(level == "HIGH", s - 0.05).otherwise(s)
    s = s + F.when(candidates >= 25, 0.12).when(candidates <= 3, -0.05).otherwise(0.0)
    s = s + F.when(tokens >= 6000, 0.10).when(tokens <= 900, -0.08).otherwise(0.0) + F.when(slm_used, 0.03).otherwise(0.0)
    s = F.when(mode_value(mode, 1, "mlm") == "llm", F.greatest(s, F.lit(0.74))).otherwise(s)
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), s)), 6)


def model_tier(mode: Column, level: Column, score: Column) -> Column:
    tier = F.when(level == "MISS", "mlm").when(score < 0.28, "slm").when(score < 0.74, "mlm").otherwise("llm")
    return F.when((mode_value(mode, 1, "mlm") == "mlm") & (tier == "slm"), "mlm").otherwise(tier)


def prompt_family(text: Column) -> Column:
    """First family with a keyword: single words at word boundaries, phrases anywhere."""
    low = F.lower(F.coalesce(text, F.lit("")))
    rule = F.when(F.trim(low) == "", "general")
    for family, words in PROMPT_FAMILIES:
        single = [w.replace("-", "\\-") for w in words if " " not in w]
        hit = low.rlike(r"\b(" + "|".join(single) + r")\b")
        if phrases := [w for w in words if " " in w]:
            hit = hit | has_any(low, phrases)
        rule = rule.when(hit, family)
    return rule.otherwise("general")


def family_sections(family: Column) -> Column:
    """The optional sections of a family, with their lengths."""
    kind = "array<struct<section:string,chars:int>>"
    out = F.array().cast(kind)
    for name, parts in FAMILY_SECTIONS.items():
        out = F.when(family == name, F.array(*[F.struct(F.lit(s).alias("section"), F.lit(n).alias("chars")) for s, n in parts]).cast(kind)).otherwise(out)
    return out


def graph_route(query: Column) -> Column:
    """Graph policy and mode hint of a query."""
    q = F.trim(F.coalesce(query, F.lit("")))
    made = lambda p, m: F.struct(F.lit(p).alias("policy"), F.lit(m).cast("string").alias("hint"))
    return F.when(q == "", made("gated", None)).when(q.rlike(RELATION), made("always", "debug_investigate")).when(q.rlike(r"^[A-Za-z_][\w.]*$"), made("off", "retrieval_fast")).when(q.rlike(r"\s"), made("gated", "explain")).otherwise(made("gated", None))


def named_confidence(query: Column, names: Column) -> Column:
    """HIGH if the first ranked name is in the query, MEDIUM if one of the first three is."""
    q = F.lower(query)
    inside = lambda n: q.contains(F.lower(n))
    return F.when(F.coalesce(inside(F.get(names, F.lit(0))), F.lit(False)), "HIGH").when(F.exists(F.slice(names, 1, 3), inside), "MEDIUM").otherwise("LOW")


def tool_phase(tool: Column) -> Column:
    t = F.lower(tool)
    return F.when(t.rlike("search|grep|glob|find|retriev"), "locate").when(t.rlike("read|view|get|open|expand"), "read").when(t.rlike("edit|write|patch|replace"), "edit").when(t.rlike("test|bash|run|exec"), "run").otherwise("other")


def project_stack(files: DataFrame) -> DataFrame:
    """(stack): the stacks whose marker files a project has.  ``files`` (path)."""
    # fixed values: marker files
    markers = {"pyproject.toml": "python", "setup.py": "python", "requirements.txt": "python", "package.json": "node", "tsconfig.json": "typescript", "go.mod": "go", "Cargo.toml": "rust", "pom.xml": "java", "build.gradle": "java", "composer.json": "php", "Gemfile": "ruby", "CMakeLists.txt": "cpp"}
    name = F.split_part(F.col("path"), F.lit("/"), F.lit(-1))
    return files.select(F.create_map(*[F.lit(x) for kv in markers.items() for x in kv])[name].alias("stack")).where("stack is not null").distinct()
