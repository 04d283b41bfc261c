"""Rows written again, lookups with defaults, samples and ranks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.runtime import settle


def latest(rows: DataFrame, keys: list[str], written: str = "written_at", ties: tuple[str, ...] = ()) -> DataFrame:
    """The row of each key written last; ties go to the greatest ``ties``.  Rows with a null key are dropped."""
    order = [F.col(c).desc_nulls_last() for c in (written, *ties)]
    known = reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in keys))
    return rows.where(known).withColumn("__weft_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__weft_r = 1").drop("__weft_r")


def union_all(parts: dict[str, DataFrame], name: str = "detector_name") -> DataFrame:
    """All rows of all parts with the part's name, in the parts' order of names; missing columns are null."""
    settle(next(iter(parts.values())).sparkSession)
    named = [df.withColumn(name, F.lit(k)) for k, df in sorted(parts.items())]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), named)


def to_do(rows: DataFrame, done: DataFrame, key: str | list[str], failed: str | None = None) -> DataFrame:
    """Rows whose key isn't in ``done``; rows of ``done`` with a value in ``failed`` are tried again."""
    keys = [key] if isinstance(key, str) else key
    finished = (done.where(F.col(failed).isNull()) if failed else done).select(*keys).dropna().distinct()
    return rows.join(finished, keys, "left_anti")


def numbered(rows: DataFrame, group: list[str], at: str, order: list[Column | str], width: int, place: str, total: str) -> DataFrame:
    """``rows`` with their place in each group by ``order``, from 0, and the group's number of rows.

    ``at`` is a number that ``order`` begins with.  Rows are numbered within stretches of
    ``width`` of it, and the numbers of earlier stretches are added, so that no task
    orders a whole group.  Rows with a null in ``group`` or ``at`` are dropped.
    """
    keys = [*group, "__weft_at"]
    known = rows.withColumn("__weft_at", F.floor(F.col(at) / width))
    known = known.where(reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in keys)))
    whole = Window.partitionBy(*group)
    earlier = whole.orderBy("__weft_at").rowsBetween(Window.unboundedPreceding, -1)
    sums = known.groupBy(*keys).agg(F.count("*").alias("__weft_c")).select(*keys, F.coalesce(F.sum("__weft_c").over(earlier), F.lit(0)).alias("__weft_b"), F.sum("__weft_c").over(whole).alias(total))
    here = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
    return known.withColumn(place, here.cast("long")).join(sums, keys).withColumn(place, F.col(place) + F.col("__weft_b")).drop("__weft_at", "__weft_b")


def systematic_sample(rows: DataFrame, group: list[str], order: list[str], limit: int, width: int | None = None) -> DataFrame:
    """``limit`` rows (1 to 40) of each group evenly spaced in ``order``: those numbered floor(i * n / limit); all rows of smaller groups.

    With ``width`` the first of ``order`` is a number, in stretches of which rows are
    numbered (see numbered); else a group is ordered in one task.
    """
    limit = max(1, min(40, limit))
    k, n = F.col("__weft_k"), F.col("__weft_n")
    picked = (n <= limit) | (F.floor(F.ceil(k * limit / n) * n / limit) == k)
    if width is not None:
        return numbered(rows, group, order[0], order, width, "__weft_k", "__weft_n").where(picked).drop("__weft_k", "__weft_n")
    w = Window.partitionBy(*group)
    return rows.withColumn("__weft_k", F.row_number().over(w.orderBy(*order)) - 1).withColumn("__weft_n", F.count("*").over(w)).where(picked).drop("__weft_k", "__weft_n")


def rename(value: Column, names: dict[str, str]) -> Column:
    """The name given to a label, else the label; blank names don't count."""
    given = {k: v for k, v in names.items() if v and v.strip()}
    if not given:
        return value
    table = F.create_map(*(F.lit(x) for pair in sorted(given.items()) for x in pair))
    return F.coalesce(table[value], value)


def first_of(rows: DataFrame, keys: list[str], choice: str, priority: list[str]) -> DataFrame:
    """Of each key the row whose ``choice`` stands first in ``priority``; other choices don't count."""
    place = F.array_position(F.array(*map(F.lit, priority)), F.col(choice))
    ranked = rows.withColumn("__weft_p", place).where("__weft_p > 0")
    return ranked.withColumn("__weft_r", F.row_number().over(Window.partitionBy(*keys).orderBy("__weft_p"))).where("__weft_r = 1").drop("__weft_p", "__weft_r")


def new_messages(log: DataFrame, order: str, message: str, group: list[str]) -> DataFrame:
    """A log without messages equal to the one just before."""
    before = F.lag(message).over(Window.partitionBy(*group).orderBy(order))
    first = F.row_number().over(Window.partitionBy(*group).orderBy(order)) == 1
    return log.withColumn("__weft_new", first | ~before.eqNullSafe(F.col(message))).where("__weft_new").drop("__weft_new")


def retried(first: DataFrame, second: DataFrame, key: str, value: str, error: str = "error") -> DataFrame:
    """``first`` (key, value, error) with the values of a second try where the first failed and the second didn't."""
    again = second.where(F.col(error).isNull()).select(key, F.col(value).alias("_v"))
    failed = F.col(error).isNotNull() & F.col("_v").isNotNull()
    joined = first.join(again, key, "left")
    return joined.select(key, F.when(failed, F.col("_v")).otherwise(F.col(value)).alias(value), F.when(~failed, F.col(error)).alias(error))


def or_default(value: Column, default: float, legacy: bool = False) -> Column:
    """``value`` or its default where it is null; with ``legacy`` also where it is 0."""
    return F.coalesce(F.nullif(value, F.lit(0)) if legacy else value, F.lit(default))


def source_order(names: DataFrame, name: str, kind: str, first: list[str]) -> DataFrame:
    """Audio sources in the order they are offered, each name once: ``first`` as listed, then lanes, then speaker tracks; hidden files are left out."""
    place = F.array_position(F.array(*map(F.lit, first)), F.col(name))
    rank = F.when(place > 0, place).when(F.col(kind) == "lane", 1000).otherwise(2000)
    seen = names.where(~F.col(name).startswith(".")).withColumn("__weft_p", rank).groupBy(name).agg(F.min("__weft_p").alias("__weft_p"))
    return seen.withColumn("place", F.row_number().over(Window.orderBy("__weft_p", name))).drop("__weft_p")


def engine_map(rows: DataFrame, key: str, engine: str, text: str) -> DataFrame:
    """(key, engines): the text of each engine by name, in one map per key; the greatest of repeated ones."""
    one = rows.groupBy(key, engine).agg(F.max(F.coalesce(text, F.lit(""))).alias("_t"))
    return one.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(engine, "_t")))).alias("engines"))


def failures(rows: DataFrame, error: str = "error", key: list[str] | None = None) -> DataFrame:
    """(key..., n, n_failed): rows and those with an error; raise_if_all_failed() takes the same counts as a check."""
    return rows.groupBy(*(key or [])).agg(F.count("*").alias("n"), F.count(error).alias("n_failed"))


def raise_if_all_failed(rows: DataFrame, error: str = "error") -> tuple[int, int]:
    """(rows, failed ones); an error if there are rows and all of them failed."""
    n, bad = failures(rows, error).first()
    if n and n == bad:
        raise RuntimeError(f"all {n} rows failed")
    return n, bad


def short_dropped(rows: DataFrame, group: list[str], length_ms: Column, least: int = 1000) -> DataFrame:
    """(group..., kept, dropped, dropped_s): rows of ``least`` ms or more, and number and seconds of the others."""
    short = length_ms < least
    return rows.groupBy(*group).agg(F.count_if(~short).alias("kept"), F.count_if(short).alias("dropped"), (F.coalesce(F.sum(F.when(short, length_ms)), F.lit(0)) / 1000).alias("dropped_s"))


def in_order(rows: DataFrame, group: list[str], order: list[Column | str], limit: int | None = None, name: str = "place") -> DataFrame:
    """``rows`` with their place in each group, from 1; only the first ``limit``, if given, which are found before the shuffle."""
    placed = rows.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
    return placed if limit is None else placed.where(F.col(name) <= limit)


def with_engine(chunks: DataFrame, transcripts: DataFrame, keys: list[str], default: str = "lane", name: str = "asr") -> DataFrame:
    """``chunks`` with the engine of their transcript, or ``default`` where there is none."""
    named = transcripts.where("engine IS NOT NULL").groupBy(*keys).agg(F.max("engine").alias("__weft_e"))
    return chunks.join(named, keys, "left").withColumn(name, F.coalesce("__weft_e", F.lit(default))).drop("__weft_e")
