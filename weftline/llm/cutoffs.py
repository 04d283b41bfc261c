"""Score cutoffs that keep a target fraction of each source's records.

Scores are coded as integers and counted in a dyadic tree per source: a node at
level l holds the number of scores whose code starts with its l bits.  The tree is
kept in a folder, one part per batch: a batch adds the counts of its rows and takes
back those of the rows that it replaces.  A cutoff is found by descending the stored
tree to the wanted rank and refining one leaf to its distinct scores.
"""

from __future__ import annotations

import posixpath
import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.runtime import SMALL_ROWS, checkpoint, shared_folder

#: Depth of the tree; a source has fewer than 2 ** (BITS + 1) nodes, whatever the number of its records.
BITS = 16
#: Distinct scores of a leaf that are ordered in one task; a leaf with more is cut into 2 ** BITS finer ones.
LEAF_SCORES = 50_000

SOURCE = ["detector", "tag"]


def source_name(c: Column) -> Column:
    """Spellings that differ in case, outer blanks or square brackets are one."""
    return F.lower(F.regexp_replace(c, r"(?U)^[\s\[\]]+|[\s\[\]]+$", ""))


def usable(score: Column) -> Column:
    """True for scores from 0 to 1; null, NaN and others are not counted."""
    return F.coalesce((score >= 0) & (score <= 1) & ~F.isnan(score), F.lit(False))


def score_code(score: Column, bits: int = BITS) -> Column:
    """Order-preserving integer of ``bits`` bits for a score from 0 to 1."""
    return F.least(F.floor(score * F.lit(float(1 << bits))), F.lit((1 << bits) - 1)).cast("long")


def newest_first(written: str = "written_at", ties: tuple[str, ...] = ("detector", "tag", "score")) -> list[Column]:
    """Order of the rows of one cand_id: that written last, of those the one with the greatest ``ties``."""
    return [F.col(c).desc_nulls_last() for c in (written, *ties)]


def count_tree(scored: DataFrame, keys: list[str], score: str = "score", weight: str | None = None, bits: int = BITS) -> DataFrame:
    """Node counts (keys..., level, node, n); ``weight`` may hold -1 to take a row back."""
    one = F.col(weight) if weight else F.lit(1)
    leaves = scored.where(usable(F.col(score))).groupBy(*keys, score_code(F.col(score), bits).alias("_c")).agg(F.sum(one.cast("long")).alias("_n")).where("_n <> 0")
    return (
        leaves.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(bits))))
        .groupBy(*keys, "level", F.expr(f"shiftright(_c, {bits} - level)").alias("node"))
        .agg(F.sum("_n").alias("n"))
        .where("n <> 0")
    )


def add_batch(tree: DataFrame, batch: DataFrame, sources: list[str]) -> DataFrame:
    """The tree of both batches."""
    return tree.unionByName(batch).groupBy(*sources, "level", "node").agg(F.sum("n").alias("n")).where("n <> 0")


def changes(known: DataFrame, batch: DataFrame) -> DataFrame:
    """What a batch does to the counts: ``batch``'s columns and w, 1 for rows that now count and -1 for those of ``known`` that no longer do.

    Both have cand_id, written_at, detector, tag and score; ``known`` has the row that
    counts of each cand_id so far, ``batch`` any rows, late and repeated ones too.
    """
    columns = ["cand_id", "written_at", *SOURCE, "score"]
    w = Window.partitionBy("cand_id").orderBy(*newest_first(), F.col("_new"))
    both = known.select(*columns, F.lit(0).alias("_new")).unionByName(batch.select(*columns, F.lit(1).alias("_new"))).where("cand_id IS NOT NULL")
    ranked = both.withColumn("_r", F.row_number().over(w)).withColumn("_won", F.max(F.when(F.col("_r") == 1, F.col("_new"))).over(Window.partitionBy("cand_id")))
    return ranked.where("_won = 1 AND (_r = 1 OR _new = 0)").select(*columns, F.when(F.col("_r") == 1, 1).otherwise(-1).alias("w"))


class TreeStore:
    """A tree kept in a folder, one part per batch; a batch written again replaces its own part."""

    def __init__(self, spark: SparkSession, path: str, sources: list[str] = SOURCE) -> None:
        self.spark, self.path, self.sources = spark, path, sources

    def add(self, batch: int, scored: DataFrame, score: str = "score", weight: str | None = None) -> None:
        """Count a batch's scores; works as the body of foreachBatch."""
        self.add_all(scored.withColumn("batch", F.lit(batch)), score, weight)

    def add_all(self, scored: DataFrame, score: str = "score", weight: str | None = None) -> None:
        """Count several batches at once, which the column ``batch`` tells apart."""
        tree = count_tree(scored.withColumn("batch", F.col("batch").cast("long")), [*self.sources, "batch"], score, weight)
        tree.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(self.path)

    def tree(self) -> DataFrame:
        """The counts of all batches; none if nothing was added."""
        schema = ", ".join([*(f"`{c}` string" for c in self.sources), "level int, node long, n long, batch long"])
        stored = self.spark.read.schema(schema).parquet(self.path)
        return stored.groupBy(*self.sources, "level", "node").agg(F.sum("n").alias("n")).where("n <> 0")


def descend(tree: DataFrame, targets: DataFrame, sources: list[str], permille: str | None = "keep_permille", bits: int = BITS) -> DataFrame:
    """For each source in ``targets``: counted, the leaf that holds the target rank, the leaf's count, and the rank left within it.

    The target rank is the least k with k * 1000 >= permille * counted, 1 at least, from
    the top; without ``permille`` it is the column rank_left of ``targets``.  Sources
    without counted scores have no row.
    """

    def walk(nodes: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        out = {**{c: [] for c in sources}, "counted": [], "leaf": [], "in_leaf": [], "rank_left": []}
        n = {(a, b): c for a, b, c in zip(nodes["level"].tolist(), nodes["node"].tolist(), nodes["n"].tolist()) if c > 0}
        counted = n.get((0, 0), 0)
        if counted and len(wanted):
            left = int(wanted["rank_left"].max()) if permille is None else -(-int(wanted[permille].max()) * counted // 1000)
            left, at = min(max(1, left), counted), 0
            for level in range(1, bits + 1):
                right = n.get((level, 2 * at + 1), 0)
                if left <= right:
                    at = 2 * at + 1
                else:
                    left, at = left - right, 2 * at
            for c in sources:
                out[c].append(nodes[c].iloc[0])
            out["counted"].append(counted)
            out["leaf"].append(at)
            out["in_leaf"].append(n[bits, at])
            out["rank_left"].append(left)
        return pd.DataFrame(out).astype(dict.fromkeys(sources, object))

    schema = ", ".join([*(f"`{c}` string" for c in sources), "counted long, leaf long, in_leaf long, rank_left long"])
    return tree.groupBy(*sources).cogroup(targets.groupBy(*sources)).applyInPandas(walk, schema)


def refine(scored: DataFrame, leaves: DataFrame, sources: list[str], score: str = "score", bits: int = BITS, few: bool = False) -> DataFrame:
    """(sources..., counted, cutoff): the highest distinct score of each leaf at which the rank left is reached.

    A leaf of more than LEAF_SCORES distinct scores is counted in a tree of its own,
    over the range of the scores that it holds, and so on; codes only need to keep the
    order of scores, which are compared themselves in the end.  Leaves whose counts
    differ from the scores in them are an error: the tree then isn't that of ``scored``.
    """
    x = F.col(score).cast("double")
    coded = scored.where(usable(x)).select(*sources, x.alias("_x"), x.alias("_part"), F.lit(1).alias("_n"))
    found = leaves = checkpoint(leaves)
    while True:
        inside = coded.withColumn("leaf", score_code(F.col("_part"), bits)).join(sized(leaves.select(*sources, "leaf"), few), [*sources, "leaf"])
        coded = checkpoint(inside.groupBy(*sources, "_x").agg(F.sum("_n").alias("_n")))
        sizes = checkpoint(coded.groupBy(*sources).agg(F.count("*").alias("_d"), F.sum("_n").alias("_all"), F.min("_x").alias("_lo"), F.max("_x").alias("_hi")))
        wrong, most = leaves.join(sizes, sources, "left").agg(F.count_if(~F.col("_all").eqNullSafe(F.col("in_leaf"))), F.max("_d")).first()
        if wrong:
            raise ValueError(f"the tree doesn't hold the counts of these scores: {wrong} sources differ")
        if (most or 0) <= LEAF_SCORES:
            break
        part = F.when(F.col("_hi") > F.col("_lo"), (F.col("_x") - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).otherwise(0.0)
        coded = coded.join(sized(sizes.select(*sources, "_lo", "_hi"), few), sources).select(*sources, "_x", part.alias("_part"), "_n")
        leaves = checkpoint(descend(count_tree(coded, sources, "_part", "_n", bits), leaves, sources, None, bits))
    above = F.sum("_n").over(Window.partitionBy(*sources).orderBy(F.col("_x").desc()).rowsBetween(Window.unboundedPreceding, 0))
    ranked = coded.withColumn("_above", above).join(sized(leaves.select(*sources, "rank_left"), few), sources)
    cut = ranked.where("_above >= rank_left").groupBy(*sources).agg(F.max("_x").alias("cutoff"))
    return cut.join(sized(found.select(*sources, "counted"), few), sources).select(*sources, "counted", "cutoff")


def sized(per_source: DataFrame, few: bool) -> DataFrame:
    """A table of at most one row per target, broadcast if the targets are few."""
    return F.broadcast(per_source) if few else per_source


def goals(targets: DataFrame) -> tuple[DataFrame, bool]:
    """The targets with one name per source, and whether they are few.

    Targets that become one source keep the greater share; those without detector, tag or share count for nothing.
    """
    goal = (
        targets.select(source_name(F.col("detector")).alias("detector"), source_name(F.col("tag")).alias("tag"), F.col("keep_permille").cast("long").alias("keep_permille"))
        .where("detector IS NOT NULL AND tag IS NOT NULL AND keep_permille IS NOT NULL")
        .groupBy(*SOURCE)
        .agg(F.max("keep_permille").alias("keep_permille"))
    )
    return goal, goal.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS


def versions(candidates: DataFrame, goal: DataFrame, few: bool) -> DataFrame:
    """(cand_id, detector, tag, score, batch, replaced): rows with a usable score of the sources in ``goal``, the month that brought them, and the one that replaced them.

    Rows without written_at come first, in month 0.  Rows without cand_id have no part.
    """
    month = F.coalesce(F.year("written_at") * 100 + F.month("written_at"), F.lit(0)).cast("long")
    rows = candidates.where("cand_id IS NOT NULL").select("cand_id", "written_at", "detector", "tag", F.col("score").cast("double").alias("score"), month.alias("batch"))
    newer = F.lag("batch").over(Window.partitionBy("cand_id").orderBy(*newest_first()))
    return (
        rows.withColumn("replaced", newer)
        .select("cand_id", source_name(F.col("detector")).alias("detector"), source_name(F.col("tag")).alias("tag"), "score", "batch", "replaced")
        .where(usable(F.col("score")))
        .join(sized(goal.select(*SOURCE), few), SOURCE, "left_semi")
    )


def _counted(rows: DataFrame, goal: DataFrame, few: bool, tree: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """The hits that count, and (detector, tag, counted, cutoff) from the stored tree of all months, or from ``tree``."""
    rows = checkpoint(rows)
    hits = rows.where("replaced IS NULL").select("cand_id", *SOURCE, "score")
    if tree is not None:
        return hits, refine(hits, descend(tree, goal, SOURCE), SOURCE, few=few)
    event = lambda batch, w: F.struct(F.col(batch).alias("batch"), F.lit(w).alias("w"))
    events = rows.select(*SOURCE, "score", F.explode(F.array_compact(F.array(event("batch", 1), F.when(F.col("replaced").isNotNull(), event("replaced", -1))))).alias("x")).select(*SOURCE, "score", "x.*")
    spark = rows.sparkSession
    with shared_folder(spark) as folder:
        store = TreeStore(spark, posixpath.join(folder, f"tree-{uuid.uuid4().hex}"))
        store.add_all(events, weight="w")
        cut = checkpoint(refine(hits, descend(store.tree(), goal, SOURCE), SOURCE, few=few))
    return hits, cut


def cutoffs(candidates: DataFrame, targets: DataFrame, tree: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(hits, cutoffs): the counted hits, and detector, tag, keep_permille, counted, cutoff, kept per source.

    Of each cand_id the row written last counts.  ``tree`` may be a kept one
    (TreeStore.tree) that holds the counts of just the hits of ``candidates`` - it
    isn't counted again, and one that holds others is an error; else a tree is
    stored month by month of written_at, each month taking back what it replaces.
    Null, NaN and impossible scores, null detectors and sources without target have
    no part.  Ties at the cutoff are all kept.  Sources without hits, and empty
    tables, give no rows.
    """
    goal, few = goals(targets)
    hits, cut = _counted(versions(candidates, goal, few), goal, few, tree)
    kept = hits.join(sized(cut, few), SOURCE).where("score >= cutoff").groupBy(*SOURCE).agg(F.count("*").alias("kept"))
    return hits, cut.join(kept, SOURCE).join(goal, SOURCE).select(*SOURCE, "keep_permille", "counted", "cutoff", "kept")


def kept_hits(candidates: DataFrame, targets: DataFrame, tree: DataFrame | None = None) -> DataFrame:
    """The cand_id of every hit that its source's cutoff keeps (see cutoffs)."""
    goal, few = goals(targets)
    hits, cut = _counted(versions(candidates, goal, few), goal, few, tree)
    return hits.join(sized(cut.select(*SOURCE, "cutoff"), few), SOURCE).where("score >= cutoff").select("cand_id")
