"""Mixing sources to target weights: hierarchical budgeting over a tree of levels (domain, language, source).

A node's capacity is its documents' tokens times ``max_epochs``.  The root's budget goes down level by level: a
node's budget is dealt among its children in proportion to their weights, no child over its capacity; what a
full child can't take goes to its siblings in proportion to theirs.  As a parent never gets more than its
children can hold, a shortage leaves the family only where all siblings are full: siblings come before
ancestors.  The level at which children are cut is found in closed form by windows over the (small) tree.

Each leaf then takes a token-prefix of its seeded epochs: epoch e orders the leaf's documents by a hash of
(seed, e, document); a leaf whose budget is q times its tokens and a rest takes q whole epochs, then the longest
prefix of the next that fits into the rest.  The prefix is found without sorting a leaf in one task: documents are
dealt into ``BUCKETS`` ranges of the hash, whole ranges below the cut are taken by their sums, and only the range
in which the cut falls is ordered.

Defined results: null level values form a node named ``(null)``; nodes with weight 0 or without weights get
nothing unless a default is given; documents without tokens are in every whole epoch and in prefixes up to the
cut; rows alike in id and tokens are taken together or not at all; an empty table gives an empty result; other columns pass through, clashing ones are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodeseam.llm.columns import SPACE
from lodeseam.session import persisted

#: The first HEX digits of a document's hash are its range: 16 ** HEX ranges.
HEX = 3
BUCKETS = 16**HEX
#: Trees up to this many leaves are broadcast to the documents; larger ones are joined by a shuffle.
BROADCAST_LEAVES = 50_000
LEVELS = ("domain", "lang", "source")
# Target weights: domain, then language in a domain; sources in a language share alike.
DOMAIN_WEIGHTS = {"web": 0.4, "books": 0.2, "news": 0.2, "forums": 0.2}
LANG_WEIGHTS = {"en": 0.55, "de": 0.15, "fr": 0.15, "es": 0.15}
DOMAINS = ["web", "books", "news", "forums"]
SEED, MAX_EPOCHS, SHARE = 20, 4, 0.6


def default_domain(source: Column) -> Column:
    """The number in a source's name modulo 4 names its domain; without a number: web."""
    n = F.coalesce(F.try_to_number(F.regexp_extract(source, r"(\d{1,9})$", 1), F.lit("999999999")).cast("int"), F.lit(0))
    return F.element_at(F.array(*[F.lit(d) for d in DOMAINS]), n % 4 + 1)


def token_count(text: Column) -> Column:
    """Words parted by white space."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), f"^[{SPACE}]+|[{SPACE}]+$", "")
    return F.when(t == "", F.lit(0)).otherwise(F.size(F.split(t, f"[{SPACE}]+"))).cast("long")


def deal(nodes: DataFrame, parent: list[str], child: str) -> DataFrame:
    """``nodes`` (parent columns, child, weight, capacity, budget of the parent) with the child's ``share``.

    With children by capacity / weight ascending, the children before the i-th are full if the level
    (budget - capacities before) / (weights from the i-th on) is under the i-th's capacity / weight; the first
    such i gives the level for all that come after.
    """
    order = [F.col("capacity") / F.col("weight"), F.col(child)]
    family = W.partitionBy(*parent) if parent else W.partitionBy(F.lit(0))
    upto = family.orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    onward = family.orderBy(*order).rowsBetween(0, W.unboundedFollowing)
    leveled = nodes.withColumn("level", (F.col("budget") - F.coalesce(F.sum("capacity").over(upto), F.lit(0))) / F.sum("weight").over(onward))
    room = F.when(F.col("capacity") >= F.col("level") * F.col("weight"), F.col("level"))
    cut = F.first(room, ignorenulls=True).over(family.orderBy(*order).rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    most = F.col("capacity").cast("double")
    return leveled.withColumn("cut", cut).withColumn("share", F.floor(F.least(most, F.coalesce(F.col("cut") * F.col("weight"), most)) + 1e-6).cast("long")).drop("level", "cut")


def leaf_budgets(leaves: DataFrame, weights: list[Column], budget: int, levels: tuple[str, ...] = LEVELS) -> DataFrame:
    """Budgets of the leaves (levels, tokens, capacity).  ``weights[i]``: a column over levels[: i + 1]."""
    for w in weights:
        leaves = leaves.where(w > 0)
    out = None
    for i, level in enumerate(levels):
        path = list(levels[: i + 1])
        nodes = leaves.groupBy(*path).agg(F.sum("capacity").alias("capacity")).withColumn("weight", weights[i].cast("double"))
        nodes = nodes.withColumn("budget", F.lit(budget).cast("long")) if out is None else nodes.join(out.select(*path[:-1], F.col("share").alias("budget")), path[:-1])
        out = deal(nodes, path[:-1], level)
    return out.select(*levels, F.col("share").alias("budget"))


def mix(spark: SparkSession, docs: DataFrame, *, text_col: str = "text", id_col: str = "doc_id", domain: Column | None = None, weights: list[Column] | None = None, share: float = SHARE, max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """The rows of ``docs`` that the mixture takes, once for each epoch, with domain, epoch and n_tokens.

    share: the mixture's tokens as a part of all tokens of ``docs``.
    """
    weights = weights or default_weights()
    keep = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("domain", "epoch", "n_tokens")]
    lang, source = (F.coalesce(F.col(c).cast("string"), F.lit("(null)")) for c in ("lang", "source"))
    named = docs.select(*keep, (default_domain(F.col("source")) if domain is None else domain).alias("domain"), lang.alias("__lang"), source.alias("__source"), token_count(F.col(f"`{text_col}`")).alias("n_tokens"))
    named = named.withColumn("domain", F.coalesce("domain", F.lit("(null)")))
    key = F.col(f"`{id_col}`").cast("string")
    leaf = ["domain", "__lang", "__source"]
    slim = persisted(spark, named.select(*leaf, key.alias("k"), "n_tokens"), "mix-counts")
    tree = persisted(spark, slim.groupBy(*leaf).agg(F.sum("n_tokens").alias("tokens")), "mix-leaves")
    tree = tree.select(F.col("domain"), F.col("__lang").alias("lang"), F.col("__source").alias("source"), "tokens", (F.col("tokens") * max_epochs).alias("capacity"))
    total = tree.agg(F.sum("tokens")).first()[0] or 0
    budgets = leaf_budgets(tree, weights, min(int(total * share), total * max_epochs)).join(tree, list(LEVELS))
    budgets = persisted(
        spark,
        budgets.where(F.col("tokens") > 0).select(F.col("domain"), F.col("lang").alias("__lang"), F.col("source").alias("__source"), F.expr("budget div tokens").alias("whole"), (F.col("budget") % F.col("tokens")).alias("rest")),
        "mix-budgets",
    )
    few = budgets.count() <= BROADCAST_LEAVES
    small = F.broadcast if few else (lambda x: x)

    def order(epoch: Column) -> Column:
        return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce("k", F.lit(""))))

    bucket = F.conv(F.substring("h", 1, HEX), 16, 10).cast("int")
    # The last epoch of a leaf, of which a prefix is taken.
    partial = slim.join(small(budgets), leaf).withColumn("h", order(F.col("whole"))).withColumn("bucket", bucket)
    sums = partial.groupBy(*leaf, "rest", "bucket").agg(F.sum("n_tokens").alias("t"))
    run = sums.withColumn("upto", F.sum("t").over(W.partitionBy(*leaf).orderBy("bucket")))
    cuts = persisted(spark, run.groupBy(*leaf, "rest").agg(F.coalesce(F.min(F.when(F.col("upto") > F.col("rest"), F.col("bucket"))), F.lit(BUCKETS)).alias("at"), F.coalesce(F.max(F.when(F.col("upto") <= F.col("rest"), F.col("upto"))), F.lit(0)).alias("before")), "mix-cuts")
    inside = partial.join(small(cuts.drop("rest")), leaf).where(F.col("bucket") == F.col("at"))
    # Rows that are alike in key and count come together; each takes its place in turn.
    edge = inside.groupBy(*leaf, "h", "n_tokens", "rest", "before").agg(F.count("*").alias("copies")).withColumn("sum", F.sum(F.col("n_tokens") * F.col("copies")).over(W.partitionBy(*leaf).orderBy("h", "n_tokens")))
    edge = edge.withColumn("room", F.col("rest") - F.col("before") - F.col("sum") + F.col("n_tokens") * F.col("copies"))
    last = edge.groupBy(*leaf).agg(F.max(F.when(F.col("room") >= F.col("n_tokens") * F.col("copies"), F.struct("h", "n_tokens"))).alias("upto_row"))
    plan = persisted(spark, budgets.join(cuts.drop("rest"), leaf, "left").join(last, leaf, "left"), "mix-plan")

    inner = {c: f"__{c}" for c in ("whole", "rest", "at", "upto_row")}
    plan = plan.select(*leaf, *[F.col(c).alias(n) for c, n in inner.items()])
    rows = named.withColumn("__k", key).join(small(plan), leaf)
    rows = rows.withColumn("__h", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("__whole").cast("string"), F.coalesce("__k", F.lit("")))))
    rows = rows.withColumn("__bucket", F.conv(F.substring("__h", 1, HEX), 16, 10).cast("int"))
    tail = (F.col("__bucket") < F.col("__at")) | ((F.col("__bucket") == F.col("__at")) & F.coalesce(F.struct(F.col("__h").alias("h"), F.col("n_tokens").alias("n_tokens")) <= F.col("__upto_row"), F.lit(False)))
    none = F.array().cast("array<bigint>")
    epochs = F.concat(F.when(F.col("__whole") > 0, F.sequence(F.lit(0).cast("long"), F.col("__whole") - 1)).otherwise(none), F.when(tail & (F.col("__rest") > 0), F.array(F.col("__whole"))).otherwise(none))
    return rows.select(*keep, "domain", "n_tokens", F.explode(epochs).alias("epoch"))


def default_weights() -> list[Column]:
    pick = lambda c, w, rest: F.coalesce(F.create_map(*[x for k, v in w.items() for x in (F.lit(k), F.lit(v))])[F.col(c)], F.lit(rest))
    return [pick("domain", DOMAIN_WEIGHTS, 0.1), pick("lang", LANG_WEIGHTS, 0.1), F.lit(1.0)]
