"""Mixing sources to target weights with hierarchical token budgets.

Sources form a tree: domain, language, source. A token budget is handed down the tree: each
node shares its budget among its children by their weights. A child whose capacity (its
tokens times `max_epochs`) is below its share keeps the capacity, and the shortage goes to
its siblings; only what all siblings together cannot take goes up to the parent's siblings.
A leaf's budget is filled from seeded epochs: whole passes first, then the prefix of a pass
in the order of a seeded hash, by tokens, that does not exceed the budget.

Allocation works on one row per leaf. The prefix is found without sorting a leaf: tokens are
summed per hash range, the range in which the budget ends is split once more, and only rows
of that small range are ordered. So a source with a third of all rows costs what others do.

Null language or source is a leaf of its own; null or empty texts have no tokens and come
with their leaf's prefix. Rows of equal hash (repeated rows) are in or out together. Weights
of 0 give nothing, missing ones count as 1. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from outboxlake.llm.store import prepare, stored

LEVELS = ("domain", "lang", "source")
#: Parts of the tokens of the table that the budget asks for, and passes over a leaf at most.
SHARE = 0.5
MAX_EPOCHS = 2
SEED = "mix-1"
#: The mix that the registered queries ask for; names that are missing weigh 1.
DOMAIN_WEIGHTS = {"domain0": 4.0, "domain1": 3.0, "domain2": 2.0, "domain3": 1.0}
LANG_WEIGHTS = {"en": 3.0, "de": 2.0}
SOURCE_WEIGHTS = {"src0": 2.0, "src1": 0.5, "src2": 4.0}
_BINS = 1 << 10
_BITS = 60


def tokens(text: Column) -> Column:
    """Words between ASCII white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t\n\x0B\f\r]+")), F.lit(0)).cast("long")


def domain(source: Column) -> Column:
    """The domain of a source where the table names none: one of four, by the source's name."""
    return F.concat(F.lit("domain"), F.pmod(F.crc32(F.coalesce(source, F.lit(""))), F.lit(4)).cast("string"))


def target_weights(spark: SparkSession) -> DataFrame:
    """The weights above as a table for `mixed`: one row per node of the tree."""
    rows = [(d, None, None, w) for d, w in DOMAIN_WEIGHTS.items()]
    rows += [(d, l, None, w) for d in DOMAIN_WEIGHTS for l, w in LANG_WEIGHTS.items()]
    rows += [(d, l, s, w) for d in DOMAIN_WEIGHTS for l in LANG_WEIGHTS for s, w in SOURCE_WEIGHTS.items()]
    return spark.createDataFrame(rows, "domain string, lang string, source string, weight double")


def seeded(seed: str, epoch: Column, doc_id: Column) -> Column:
    """A 60-bit order of a leaf's rows for one epoch."""
    text = F.concat_ws(":", F.lit(seed), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def shared_out(nodes: DataFrame, parent: list[str], own: str) -> DataFrame:
    """Fills `got` of each child: its part of the parent's `budget`, at most its `capacity`.

    In the order of capacity per weight, children are full as long as their capacity is below
    their share of what is left; the others share the rest by weight.
    """
    keys = [F.col(c) for c in parent] or [F.lit(0)]
    ratio = F.col("capacity") / F.col("weight")
    nodes = nodes.where("weight > 0").withColumn("ratio", ratio)
    order = Window.partitionBy(*keys).orderBy("ratio", F.col(own).asc_nulls_first())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    nodes = nodes.withColumn("used", F.coalesce(F.sum("capacity").over(before), F.lit(0)))
    nodes = nodes.withColumn("passed", F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    nodes = nodes.withColumn("total", F.sum("weight").over(Window.partitionBy(*keys)))
    level = (F.col("budget") - F.col("used")) / (F.col("total") - F.col("passed"))
    nodes = nodes.withColumn("level", level).withColumn("is_full", F.col("ratio") <= F.col("level"))
    final = F.min(F.when(~F.col("is_full"), F.struct("ratio", F.col("level").alias("value")))).over(Window.partitionBy(*keys))
    got = F.when(F.col("is_full"), F.col("capacity")).otherwise(F.floor(F.col("weight") * F.greatest(final["value"], F.lit(0.0))))
    return nodes.withColumn("got", F.least(F.col("capacity"), got.cast("long"))).drop(
        "ratio", "used", "passed", "total", "level", "is_full"
    )


def budgets(leaves: DataFrame, budget: Column, weights: DataFrame | None, max_epochs: int) -> DataFrame:
    """(domain, lang, source, have, got) from (domain, lang, source, have): one row per leaf.

    `weights` has (domain, lang, source, weight); null below a node's level names the node.
    """
    leaves = leaves.withColumn("capacity", F.col("have") * max_epochs)
    below = None
    for depth in range(len(LEVELS)):
        path = list(LEVELS[: depth + 1])
        nodes = leaves.groupBy(*path).agg(F.sum("capacity").alias("capacity"), F.sum("have").alias("have"))
        if weights is None:
            nodes = nodes.withColumn("weight", F.lit(1.0))
        else:
            own = weights
            for level in LEVELS[depth + 1 :]:
                own = own.where(F.col(level).isNull())
            own = own.where(F.col(path[-1]).isNotNull()).groupBy(*path).agg(F.max("weight").cast("double").alias("weight"))
            own = own.select(*(F.col(c).alias(f"w_{c}") for c in path), "weight")
            same = [F.col(c).eqNullSafe(F.col(f"w_{c}")) for c in path]
            joined = nodes.join(own, same, "left").drop(*(f"w_{c}" for c in path))
            nodes = joined.withColumn("weight", F.coalesce("weight", F.lit(1.0)))
        if below is None:
            nodes = nodes.withColumn("budget", budget)
        else:
            up = below.select(*(F.col(c).alias(f"p_{c}") for c in path[:-1]), F.col("got").alias("budget"))
            same = [F.col(c).eqNullSafe(F.col(f"p_{c}")) for c in path[:-1]]
            nodes = nodes.join(up, same).drop(*(f"p_{c}" for c in path[:-1]))
        below = shared_out(nodes, path[:-1], path[-1])
    return below.select(*LEVELS, "have", "got")


def _last_kept(rows: DataFrame, need: DataFrame) -> DataFrame:
    """(leaf, last): the largest `key` of each leaf that its partial pass still takes, or -1."""
    shift = _BITS - 10
    rows = rows.join(need, "leaf").where("rest > 0")
    first = rows.groupBy("leaf", F.shiftright("key", shift).alias("bin")).agg(F.sum("n").alias("n"), F.max("rest").alias("rest"))
    running = Window.partitionBy("leaf").orderBy("bin")
    # Of at most 1024 ranges a leaf, the first one that goes beyond the budget.
    first = first.withColumn("so_far", F.sum("n").over(running))
    cut = first.where("so_far > rest").groupBy("leaf").agg(F.min(F.struct("bin", "so_far", "n", "rest")).alias("c"))
    cut = cut.select("leaf", F.col("c.bin").alias("bin"), (F.col("c.rest") - F.col("c.so_far") + F.col("c.n")).alias("left"))
    inner = rows.withColumn("bin", F.shiftright("key", shift)).join(cut, ["leaf", "bin"])
    second = inner.groupBy("leaf", "bin", F.shiftright("key", shift - 10).alias("part")).agg(F.sum("n").alias("n"), F.max("left").alias("left"))
    second = second.withColumn("so_far", F.sum("n").over(Window.partitionBy("leaf").orderBy("part")))
    fine = second.where("so_far > left").groupBy("leaf").agg(F.min(F.struct("part", "so_far", "n", "left")).alias("c"))
    fine = fine.select("leaf", F.col("c.part").alias("part"), (F.col("c.left") - F.col("c.so_far") + F.col("c.n")).alias("left"))
    inner = rows.withColumn("part", F.shiftright("key", shift - 10)).join(fine, ["leaf", "part"])
    inner = inner.groupBy("leaf", "part", "key").agg(F.sum("n").alias("n"), F.max("left").alias("left"))
    inner = inner.withColumn("so_far", F.sum("n").over(Window.partitionBy("leaf").orderBy("key")))
    edge = inner.where("so_far > left").groupBy("leaf").agg(F.min("key").alias("edge"))
    everything = F.lit((1 << _BITS) - 1)
    return need.join(edge, "leaf", "left").select(
        "leaf", "full", F.when(F.col("rest") <= 0, F.lit(-1)).otherwise(F.coalesce(F.col("edge") - 1, everything)).alias("last")
    )


def mixed(
    docs: DataFrame, weights: DataFrame | None = None, share: float = SHARE, max_epochs: int = MAX_EPOCHS, seed: str = SEED
) -> DataFrame:
    """The chosen rows of `docs` with their columns, `tokens`, `domain` and `copies` (passes).

    Input columns of these names are replaced, but for a `domain`, which is used.
    """
    prepare(docs.sparkSession)
    if "domain" not in docs.columns:
        docs = docs.withColumn("domain", domain(F.col("source")))
    docs = docs.drop("tokens", "copies")
    leaf = F.md5(F.to_json(F.struct(*LEVELS)))
    full_pass = [seeded(seed, F.lit(k), F.col("doc_id")) for k in range(max_epochs)]
    narrow = docs.select(*LEVELS, leaf.alias("leaf"), "doc_id", tokens(F.col("text")).alias("n"))
    narrow = stored(narrow, "tokens")
    leaves = narrow.groupBy("leaf", *LEVELS).agg(F.sum("n").alias("have"))
    leaves = stored(leaves, "leaves")
    total = leaves.agg(F.coalesce(F.floor(F.sum("have") * F.lit(share)), F.lit(0)).cast("long").alias("t")).first()["t"]
    got = budgets(leaves, F.lit(total), weights, max_epochs).join(
        leaves.select("leaf", *(F.col(c).alias(f"l_{c}") for c in LEVELS)),
        [F.col(c).eqNullSafe(F.col(f"l_{c}")) for c in LEVELS],
    )
    whole = F.when(F.col("have") > 0, F.floor(F.col("got") / F.greatest(F.col("have"), F.lit(1)))).otherwise(F.lit(0)).cast("int")
    need = stored(got.select("leaf", whole.alias("full"), (F.col("got") - whole * F.col("have")).alias("rest")), "budgets")
    # The partial pass of a leaf is the one after its whole passes.
    key = F.coalesce(*(F.when(F.col("full") == k, full_pass[k]) for k in range(max_epochs)), F.lit(0).cast("long"))
    rows = narrow.join(need.select("leaf", "full"), "leaf").select("leaf", key.alias("key"), "n")
    last = stored(_last_kept(rows, need), "prefixes")
    # Each row travels whole in one column, so that none of its names meets a helper's.
    held = docs.select(F.struct(*docs.columns).alias("doc"), leaf.alias("leaf")).join(last, "leaf")
    own = [seeded(seed, F.lit(k), F.col("doc.doc_id")) for k in range(max_epochs)]
    key = F.coalesce(*(F.when(F.col("full") == k, own[k]) for k in range(max_epochs)), F.lit(0).cast("long"))
    copies = F.col("full") + (key <= F.col("last")).cast("int")
    return held.select("doc.*", tokens(F.col("doc.text")).alias("tokens"), copies.alias("copies")).where("copies > 0")
