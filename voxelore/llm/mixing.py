"""Mixing sources to target weights by hierarchical budgeting.

A token budget runs down a tree of levels (domain, language, source). Each node deals its budget to its children by weight,
none getting more than its capacity, the tokens below it times MAX_EPOCHS; what a child can't take goes to its siblings by
weight (water filling). As a node gets at most what its subtree can take, shortages are made up among siblings first and
pass to the ancestors' other branches only when the whole subtree is short. A leaf takes whole epochs of its documents and
then the token-prefix of a last one, each epoch in its own seeded order. `select_mix` ends that prefix before the document that
crosses the budget, as its SQL does, unless told to cut; `mixed_rows` cuts that document's text, so that a leaf gets all its budget.

Only DataFrame functions are used. Prefix sums run over 4096 buckets of the order's hash for each leaf and then within the
bucket, so that a leaf of a third of all rows is dealt over as many tasks. A document costs its words and one end mark.

Defined cases: a null or empty text costs the end mark; null levels count as the empty label; weights of zero or less give
nothing; equal ids share their place in the order and are told apart
by the text's hash, equal rows by their number; each is taken by itself. Further columns pass through `mixed_rows` untouched,
whatever their names. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voxelore.llm.store import written

SEED, MAX_EPOCHS, SHARE = 11, 2, 0.5
BUCKET_DIGITS = 3


def words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"))


def cut_text(text: Column, tokens: Column) -> Column:
    """The text's beginning that takes so many tokens, one of which is the end mark."""
    return F.array_join(F.slice(F.regexp_extract_all(text, F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), 0), F.lit(1), (tokens - 1).cast("int")), "")


def domain_of(source: Column, domains: int = 4) -> Column:
    """The top level where a table has none: the number at the end of the source's name, modulo `domains`."""
    number = F.coalesce(F.regexp_extract(source, "([0-9]{1,9})$", 1).try_cast("long"), F.lit(0))
    return F.concat(F.lit("domain"), (number % domains).cast("string"))


def _order(seed: int, epoch: Column, doc_id: Column) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))


def _weight(level: Column, weights: dict[str, float]) -> Column:
    out = F.lit(1.0)
    for label, w in sorted(weights.items()):
        out = F.when(level == label, F.lit(float(w))).otherwise(out)
    return out


def budgets(leaves: DataFrame, levels: list[str], total: Column | float, weights: dict[str, dict[str, float]], max_epochs: int) -> DataFrame:
    """leaves(levels..., tokens) with the column budget added, from the root down."""
    caps = leaves.withColumn("cap", F.col("tokens").cast("double") * max_epochs)
    nodes = caps.agg(F.least(F.lit(total).cast("double") if not isinstance(total, Column) else total, F.sum("cap")).alias("given"))
    for depth in range(1, len(levels) + 1):
        path, above = levels[:depth], levels[: depth - 1]
        kids = caps.groupBy(*path).agg(F.sum("cap").alias("cap"))
        kids = kids.join(nodes, above) if above else kids.crossJoin(F.broadcast(nodes))  # the root is one row
        kids = kids.withColumn("w", F.greatest(_weight(F.col(path[-1]), weights.get(path[-1], {})), F.lit(0.0)))
        kids = kids.withColumn("ratio", F.when(F.col("w") > 0, F.col("cap") / F.col("w")))
        by = W.partitionBy(*(above or [F.lit(0)])).orderBy(F.col("ratio").asc_nulls_last(), path[-1])
        filled = F.coalesce(F.sum(F.when(F.col("w") > 0, F.col("cap"))).over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
        open_w = F.sum("w").over(by.rowsBetween(0, W.unboundedFollowing))
        kids = kids.withColumns({"rest": F.col("given") - filled, "open_w": open_w})
        kids = kids.withColumn("level", F.when((F.col("w") > 0) & (F.col("rest") < F.col("ratio") * F.col("open_w")), F.col("rest") / F.col("open_w")))
        top = F.max("level").over(W.partitionBy(*(above or [F.lit(0)])))
        share = F.when(F.col("w") <= 0, 0.0).when(F.col("level").isNull(), F.col("cap")).otherwise(top * F.col("w"))
        nodes = kids.select(*path, share.alias("given"))
    return leaves.join(nodes.select(*levels, F.floor(F.col("given") + 1e-6).cast("long").alias("budget")), levels)


def select_mix(
    docs: DataFrame,
    levels: dict[str, Column],
    weights: dict[str, dict[str, float]] | None = None,
    share: float = SHARE,
    max_epochs: int = MAX_EPOCHS,
    seed: int = SEED,
    id_col: str = "doc_id",
    text_col: str = "text",
    cut: bool = False,
) -> DataFrame:
    """(id, row, nth, levels..., n_tokens, epoch, budget): a row for each time that a document is taken.

    share: the root's budget as a part of all tokens. `row` tells rows of the same id apart by their text, `nth` equal ones by
    their number. cut: the document
    that crosses a leaf's budget is taken too; the column `taken` says how many of its tokens.
    """
    names = list(levels)
    rows = docs.select(
        F.col(id_col).alias("id"),
        F.xxhash64(F.col(text_col)).alias("row"),
        *[F.coalesce(c.cast("string"), F.lit("")).alias(n) for n, c in levels.items()],
        (words(F.col(text_col)) + 1).cast("long").alias("n_tokens"),
    )
    # Equal rows (same id, text and leaf) are told apart by their number among themselves.
    rows = written(rows.withColumn("nth", F.row_number().over(W.partitionBy("id", "row", *names).orderBy("n_tokens"))), "mix-rows")
    leaves = written(rows.groupBy(*names).agg(F.sum("n_tokens").alias("tokens")), "mix-leaves")
    total = F.floor(F.sum("tokens") * share).cast("double")
    given = written(budgets(leaves, names, total, weights or {}, max_epochs), "mix-budgets")
    given = given.withColumn("whole", F.floor(F.col("budget") / F.col("tokens"))).withColumn("rest", F.col("budget") - F.col("whole") * F.col("tokens"))
    rows = rows.join(given, names)
    whole = rows.where("whole > 0").select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("whole") - 1)).alias("epoch"))
    part = rows.where("rest > 0").withColumn("epoch", F.col("whole")).withColumn("order", _order(seed, F.col("epoch"), F.col("id")))
    part = part.withColumn("bucket", F.substring("order", 1, BUCKET_DIGITS))
    sums = part.groupBy(*names, "bucket").agg(F.sum("n_tokens").alias("in_bucket"), F.first("rest").alias("need"))
    before = F.coalesce(F.sum("in_bucket").over(W.partitionBy(*names).orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sums = sums.withColumn("before", before).where("before < need").select(*names, "bucket", "before")
    within = W.partitionBy(*names, "bucket").orderBy("order", "id", "row", "nth").rowsBetween(W.unboundedPreceding, 0)
    part = part.join(sums, [*names, "bucket"]).withColumn("upto", F.col("before") + F.sum("n_tokens").over(within))
    part = part.where("upto - n_tokens < rest" if cut else "upto <= rest").withColumn("taken", F.least("n_tokens", F.expr("rest - (upto - n_tokens)")))
    whole = whole.withColumn("taken", F.col("n_tokens"))
    out = ["id", "row", "nth", *names, "n_tokens", "epoch", "budget", *(["taken"] if cut else [])]
    return whole.select(out).unionByName(part.select(out))


def mixed_rows(docs: DataFrame, levels: dict[str, Column], id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of docs in the mix, as often as they are taken, with their own columns; the last text of a leaf is cut to its budget."""
    chosen = written(select_mix(docs, levels, id_col=id_col, text_col=text_col, cut=True, **how), "mix-taken")
    free = _free_names(docs.columns, ["id", "row", "nth", "taken", *[f"leaf{k}" for k in range(len(levels))]])
    leaf = [free[f"leaf{k}"] for k in range(len(levels))]
    keyed = docs.withColumns({free["row"]: F.xxhash64(F.col(text_col))} | {n: F.coalesce(c.cast("string"), F.lit("")) for n, c in zip(leaf, levels.values(), strict=True)})
    keyed = keyed.withColumn(free["nth"], F.row_number().over(W.partitionBy(id_col, free["row"], *leaf).orderBy(free["row"])))
    mine = chosen.select(F.col("id").alias(free["id"]), "row", "nth", *levels, F.when(F.col("taken") < F.col("n_tokens"), F.col("taken")).alias(free["taken"]))
    on = keyed[id_col].eqNullSafe(mine[free["id"]]) & (keyed[free["row"]] == mine["row"]) & (keyed[free["nth"]] == mine["nth"])
    for n, level in zip(leaf, levels, strict=True):
        on = on & (keyed[n] == mine[level])
    own = keyed.alias("own").join(mine, on)
    text = F.when(F.col(free["taken"]).isNull(), F.col(f"own.`{text_col}`")).otherwise(cut_text(F.col(f"own.`{text_col}`"), F.col(free["taken"])))
    return own.select(*[text.alias(c) if c == text_col else F.col(f"own.`{c}`") for c in docs.columns])


def _free_names(taken: list[str], names: list[str]) -> dict[str, str]:
    """A name for each, with as many underscores before it as no column has."""
    lead = "__"
    while any(c.startswith(lead) for c in taken):
        lead += "_"
    return {n: lead + n for n in names}
