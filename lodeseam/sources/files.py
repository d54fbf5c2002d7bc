"""Readers of source trees, logs and layered settings; an index that is saved and loaded as versioned tables."""

from __future__ import annotations

import fnmatch
import json
import os
import re
import uuid
from dataclasses import dataclass, fields, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# fixed values: languages by suffix, and what is never read
LANGUAGES = {".py": "python", ".pyw": "python", ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".cjs": "javascript", ".ts": "typescript", ".tsx": "typescript", ".java": "java", ".go": "go", ".rs": "rust", ".c": "cpp", ".h": "cpp", ".cpp": "cpp", ".hpp": "cpp", ".cc": "cpp", ".cxx": "cpp", ".cs": "csharp", ".php": "php", ".rb": "ruby"}
IGNORED = ["node_modules/", ".git/", "__pycache__/", "venv/", ".venv/", "dist/", "build/", "*.min.js", "*.pyc", "*.egg-info/"]


def ignore_condition(path: Column, patterns: list[str]) -> Column:
    """``dir/`` meets any folder of the path (globs allowed); other patterns meet the whole path or its last part."""
    folders = F.slice(F.split(path, "/"), 1, F.greatest(F.lit(0), F.size(F.split(path, "/")) - 1))
    name = F.split_part(path, F.lit("/"), F.lit(-1))
    out = F.lit(False)
    for p in (x.strip() for x in patterns):
        if not p or p.startswith("#"):
            continue
        regex = "^" + re.sub(r"\\z|\\Z", "", fnmatch.translate(p.rstrip("/"))).replace("(?s:", "(?:") + "$"
        out = out | (F.exists(folders, _like(regex)) if p.endswith("/") else path.rlike(regex) | name.rlike(regex))
    return out


def _like(regex: str):  # noqa: ANN202
    return lambda c: c.rlike(regex)


def language_of(path: Column) -> Column:
    suffix = F.lower(F.regexp_extract(path, r"(\.[A-Za-z]+)$", 1))
    return F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])[suffix]


def read_sources(spark: SparkSession, root: str, extra_ignore: list[str] | None = None) -> DataFrame:
    """(path, language, content, sha) of the source files below ``root``; unknown suffixes are left out."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = re.escape(re.sub(r"^[a-z]+:/*", "/", root).rstrip("/"))
    path = F.regexp_replace(F.regexp_replace("path", r"^[a-z]+:/*", "/"), f"^{base}/", "")
    rows = raw.select(path.alias("path"), "content").withColumn("language", language_of(F.col("path"))).where("language is not null")
    # Bytes that aren't UTF-8 become the replacement character.
    return rows.where(~ignore_condition(F.col("path"), IGNORED + (extra_ignore or []))).select("path", "language", F.decode("content", "UTF-8").alias("content"), F.sha2("content", 256).alias("sha"))


def body_lines(content: Column, first: Column, last: Column) -> Column:
    """Lines ``first`` to ``last`` (from 1, both included)."""
    return F.array_join(F.slice(F.split(content, "\n"), first, F.greatest(F.lit(0), last - first + 1)), "\n")


def numbered(content: Column, first: Column) -> Column:
    """A body with line numbers."""
    return F.array_join(F.transform(F.split(content, "\n"), lambda x, i: F.concat((first + i).cast("string"), F.lit("| "), x)), "\n")


# fixed values: rows of the logs
LOGS = {
    "decisions": "ts double, summary string, rationale string, files array<string>, topics array<string>",
    "turns": "turn_index int, user_prompt string, files_modified array<string>, summary string, agent_action string",
    "queue": "fqn string, file_path string, line_start int, line_end int, signature string, enqueued_at double",
}


def append_log(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def read_log(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """A log's rows; bad lines are left out."""
    return spark.read.schema(LOGS[kind]).option("mode", "DROPMALFORMED").json(path)


def decisions_on(log: DataFrame, topic: str, n: int = 10) -> DataFrame:
    """Newest decisions whose topics, summary or rationale hold the topic."""
    t = F.lit(topic.lower())
    hit = F.exists("topics", lambda x: F.lower(x).contains(t)) | F.lower("summary").contains(t) | F.lower("rationale").contains(t)
    return log.where(hit).orderBy(F.desc("ts"), "summary").limit(n)


def constraints(texts: DataFrame) -> DataFrame:
    """(id, scope_dir, text, provenance, confirmed) from ``<!-- constraint[: provenance][ ok] -->`` blocks of (dir, text)."""
    parts = F.regexp_extract_all("text", F.lit(r"(<!--\s*constraint[^>]*-->\s*[^<]+)"), 1)
    one = texts.select(F.col("dir").alias("scope_dir"), F.explode(parts).alias("p"))
    body = F.regexp_replace(F.regexp_replace("p", r"<!--[^>]*-->", ""), r"^\s+|\s+$", "")
    rows = one.select("scope_dir", body.alias("text"), F.coalesce(F.nullif(F.regexp_extract("p", r"constraint:\s*(\w+)", 1), F.lit("")), F.lit("user")).alias("provenance"), F.col("p").rlike(r"\bok\s*-->").alias("confirmed"))
    return rows.dropDuplicates(["scope_dir", "text"]).withColumn("id", F.substring(F.sha1("text"), 1, 8))


def constraints_for(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """(path, id, text): rules of every folder above a path, as an equi-join on the folders."""
    parts = F.split("path", "/")
    folders = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    return paths.select("path", F.explode(folders).alias("scope_dir")).join(rules, "scope_dir").select("path", "id", "text")


@dataclass(frozen=True)
class Settings:
    """Knobs of the engine: defaults, then a JSON file, then environment variables ``LODESEAM_<NAME>``."""

    k1: float = 1.5
    b: float = 0.75
    rrf_k: int = 60
    top_k: int = 10
    budget: int = 8000
    graph_policy: str = "gated"
    min_score: float = 0.05

    @classmethod
    def load(cls, path: str | None = None, env: dict[str, str] | None = None) -> Settings:
        """Unknown names are passed over."""
        out, kinds = cls(), {f.name: type(f.default) for f in fields(cls)}
        layers: list[dict] = []
        if path and os.path.exists(path):
            with open(path) as f:
                layers.append(json.load(f))
        env = os.environ if env is None else env
        layers.append({k[9:].lower(): v for k, v in env.items() if k.startswith("LODESEAM_")})
        for layer in layers:
            out = replace(out, **{k: kinds[k](v) for k, v in layer.items() if k in kinds})
        return out


def save_index(spark: SparkSession, folder: str, tables: dict[str, DataFrame]) -> str:
    """Writes all tables to a new version; the manifest row that names it comes last, so readers see all or nothing."""
    version = uuid.uuid4().hex
    for name, df in tables.items():
        df.write.parquet(f"{folder}/{version}/{name}")
    row = spark.createDataFrame([(version, sorted(tables))], "version string, tables array<string>").withColumn("at", F.current_timestamp())
    row.coalesce(1).write.mode("append").json(f"{folder}/manifest")
    return version


def load_index(spark: SparkSession, folder: str) -> dict[str, DataFrame] | None:
    """The newest version's tables; None where there is none; a table that is missing is left out."""
    try:
        row = spark.read.schema("version string, tables array<string>, at timestamp").json(f"{folder}/manifest").orderBy(F.desc("at"), F.desc("version")).first()
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise
    return {n: spark.read.parquet(f"{folder}/{row['version']}/{n}") for n in row["tables"]} if row else None


def bloom_table(items: DataFrame, column: str, bits: int = 1 << 17, hashes: int = 7) -> DataFrame:
    """(word, mask): a Bloom filter as a table of 63-bit words; merged by ``bit_or``, read by ``maybe_in``."""
    places = F.array(*[F.pmod(F.xxhash64(F.lit(i), F.col(column)), F.lit(bits)) for i in range(hashes)])
    rows = items.select(F.explode(places).alias("p"))
    return rows.groupBy((F.expr("p div 63")).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, int(p % 63))")).alias("mask"))


def maybe_in(items: DataFrame, column: str, bloom: DataFrame, bits: int = 1 << 17, hashes: int = 7) -> DataFrame:
    """Rows that may be in the filter: all that are, and few others."""
    places = F.array(*[F.pmod(F.xxhash64(F.lit(i), F.col(column)), F.lit(bits)) for i in range(hashes)])
    probes = items.select(F.col(column).alias("__item")).distinct().withColumn(column, F.col("__item")).select("__item", F.explode(places).alias("p"))
    hits = probes.join(F.broadcast(bloom), F.expr("p div 63") == F.col("word"), "left").groupBy("__item").agg(F.min(F.coalesce(F.getbit("mask", (F.col("p") % 63).cast("int")), F.lit(0))).alias("all"))
    return items.join(hits.where("all = 1").select(F.col("__item").alias(column)), column, "left_semi")


def transcript_calls(runs: DataFrame) -> DataFrame:
    """(run, id, tool, turn, output): tool uses of nested transcripts joined to their results on the id.

    ``runs`` (run, turns array<struct<uses array<struct<id, tool>>, results array<struct<id, output>>>>).
    """
    turns = runs.select("run", F.posexplode("turns").alias("turn", "t"))
    uses = turns.select("run", "turn", F.explode("t.uses").alias("u")).select("run", "turn", F.col("u.id").alias("id"), F.col("u.tool").alias("tool"))
    results = turns.select("run", F.explode("t.results").alias("r")).select("run", F.col("r.id").alias("id"), F.col("r.output").alias("output"))
    return uses.join(results, ["run", "id"], "left")


def save_vectors(spark: SparkSession, folder: str, vectors: DataFrame, model: str) -> str:
    """(doc_id, vec) as one version with its count and size."""
    v = spark.createDataFrame([(model,)], "model string")
    size = vectors.agg(F.count("*").alias("n"), F.min(F.size("vec")).alias("least"), F.max(F.size("vec")).alias("most"))
    return save_index(spark, folder, {"vectors": vectors.select("doc_id", "vec"), "about": v.join(size)})


def load_vectors(spark: SparkSession, folder: str, ids: DataFrame | None = None) -> DataFrame | None:
    """The saved vectors; an error where their number isn't what was saved, or an id of ``ids`` has none."""
    tables = load_index(spark, folder)
    if tables is None:
        return None
    about, vectors = tables["about"].first(), tables["vectors"]
    if vectors.count() != about["n"] or about["least"] != about["most"]:
        raise ValueError(f"{folder}: {about['n']} vectors of {about['least']} to {about['most']} numbers were saved")
    if ids is not None and not ids.join(vectors, "doc_id", "left_anti").isEmpty():
        raise ValueError(f"{folder}: some ids have no vector")
    return vectors


# fixed values: weights of the confidence factors, and the cuts of its levels
DEFAULT_CALIBRATION = {"weights": {"entity_match": 0.35, "coverage": 0.25, "ambiguity": 0.15, "dependency_depth": 0.15, "cross_file": 0.10}, "thresholds": {"HIGH": 0.70, "MEDIUM": 0.40, "LOW": 0.20}}


def save_calibration(path: str, calibration: dict) -> None:
    """Whole or not at all."""
    with open(f"{path}.tmp", "w") as f:
        json.dump(calibration, f, indent=2)
    os.replace(f"{path}.tmp", path)


def load_calibration(path: str) -> dict:
    """The defaults where there is no readable file; a part that is missing takes its default."""
    try:
        with open(path) as f:
            found = json.load(f)
        return {k: {**v, **found.get(k, {})} for k, v in DEFAULT_CALIBRATION.items()}
    except (OSError, ValueError, AttributeError, TypeError):
        return {k: dict(v) for k, v in DEFAULT_CALIBRATION.items()}


TASKS = "task_id string, repo string, query string, gold_files array<string>, gold_fqns array<string>, patch string"


def read_tasks(spark: SparkSession, path: str) -> DataFrame:
    """An evaluation set, a JSON object a line; what a task's gold lacks is taken from its patch."""
    rows = spark.read.schema(TASKS).option("mode", "DROPMALFORMED").json(path)
    files, fqns = patch_gold(F.col("patch"))
    return rows.withColumn("gold_files", F.coalesce("gold_files", files)).withColumn("gold_fqns", F.coalesce("gold_fqns", fqns))


def patch_gold(patch: Column) -> tuple[Column, Column]:
    """Files of a unified diff, and the declarations that its hunk headers name, as ``file::name``; each once, in order."""
    # A file's part runs from its ``+++`` line to the next one's.
    parts = F.split(F.concat(F.lit("\n"), F.coalesce(patch, F.lit(""))), r"\n\+\+\+ b/")
    later = F.slice(parts, 2, F.greatest(F.lit(0), F.size(parts) - 1))
    name = lambda p: F.trim(F.split_part(p, F.lit("\n"), F.lit(1)))
    header = r"(?m)^@@[^@\n]*@@[^\n]*?\b(?:def|class|func(?:tion)?(?:\s*\([^)]*\))?|interface|struct|fn)\s+([A-Za-z_$][\w$]*)"
    fqns = F.flatten(F.transform(later, lambda p: F.transform(F.regexp_extract_all(p, F.lit(header), 1), lambda n: F.concat(name(p), F.lit("::"), n))))
    return F.array_distinct(F.transform(later, name)), F.array_distinct(fqns)


def changed_lines(diffs: DataFrame) -> DataFrame:
    """(id, file, line): lines of the old files that a unified diff (id, diff) shows or inserts at.

    Every line of a diff is numbered; a hunk's old line is its start and the old-side lines before it in the hunk.
    """
    lines = diffs.select("id", F.posexplode(F.split(F.coalesce("diff", F.lit("")), "\r?\n")).alias("at", "x"))
    upto = W.partitionBy("id").orderBy("at")
    file = F.when(F.col("x").startswith("+++ b/"), F.trim(F.substring("x", 7, 1 << 20)))
    start = F.when(F.col("x").rlike(r"^@@ -\d+"), F.regexp_extract("x", r"^@@ -(\d+)", 1).cast("long"))
    rows = lines.withColumn("file", F.last(file, True).over(upto)).withColumn("start", F.last(start, True).over(upto)).withColumn("hunk", F.sum(start.isNotNull().cast("long")).over(upto))
    inside = rows.where("file IS NOT NULL AND start IS NOT NULL").where(~F.col("x").rlike(r"^(@@|\+\+\+|---|diff |index )") & F.col("x").rlike("^[-+ ]"))
    old = F.col("x").rlike("^[- ]").cast("long")
    before = F.sum(old).over(W.partitionBy("id", "hunk").orderBy("at")) - old
    return inside.withColumn("line", F.col("start") + before).select("id", "file", "line").distinct()


def write_report(rows: DataFrame, path: str, kind: str = "json") -> None:
    """A result as JSON, CSV or a markdown table (one file: a report is an answer of bounded length)."""
    if kind == "json":
        rows.coalesce(1).write.mode("overwrite").json(path)
    elif kind == "csv":
        rows.coalesce(1).write.mode("overwrite").option("header", True).csv(path)
    elif kind == "markdown":
        cells = lambda cs: F.concat(F.lit("| "), F.concat_ws(" | ", *cs), F.lit(" |"))
        body = rows.select(F.lit(1).alias("n"), cells([F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in rows.columns]).alias("value"))
        head = rows.sparkSession.createDataFrame([(0, "| " + " | ".join(rows.columns) + " |"), (0, "|" + "-|" * len(rows.columns))], "n int, value string")
        head.coalesce(1).unionByName(body).coalesce(1).select("value").write.mode("overwrite").text(path)
    else:
        raise ValueError(kind)
