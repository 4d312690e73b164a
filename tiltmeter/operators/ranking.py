"""Keep-first/last and rank cuts that never sort one whole group in one task.

Groups here are event classes, models or countries: there are few of them and
one may hold a third of all rows. A ``row_number`` over such a group would sort
that third in a single task, so

* de-duplication keeps one row per key in every task before the shuffle;
* "first n rows of each group" finds the cut point by histograms that narrow
  down to one small bucket, ranks only that bucket, and then compares every row
  with the cut in a plain filter.

A top-k with a small constant k needs none of this: Spark keeps k rows per task
before the shuffle when a ``row_number`` is compared with a literal.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.tables import sized_table


def keep_one(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], last: bool = False) -> DataFrame:
    """One row per key: the first (or last) in the given total order.

    The rank is compared with a literal, so every task keeps one row per key
    before the shuffle: a third of all rows may be copies of one key. Columns
    that nobody reads later are pruned before the shuffle.
    """
    by = [F.col(c) if isinstance(c, str) else c for c in order]
    w = Window.partitionBy(*keys).orderBy(*[c.desc() if last else c.asc() for c in by])
    return df.withColumn("_first", F.row_number().over(w)).where(F.col("_first") == 1).drop("_first")


def sample_hash(seed: int | str, id_col: str) -> Column:
    """Stable pseudo-random order of ids, the same in every engine that has md5."""
    return F.md5(F.concat(F.lit(f"{seed}|"), F.col(id_col).cast("string")).cast("binary"))


def hash_levels(h: str) -> list[Column]:
    """4,096 prefixes, then 4,096 more inside the one that a cut falls in, so that hardly any row of a group is ranked."""
    return [F.substring(F.col(h), 1, 3), F.substring(F.col(h), 1, 6)]


def mark_bands(df: DataFrame, keys: Sequence[str], cuts: DataFrame, order: Sequence[Column],
               levels: Sequence[Column], band: str = "band") -> DataFrame:
    """Add ``band``: how many of its group's cuts a row lies behind, in ascending ``order``.

    ``cuts`` holds (keys, cut_no, need): cut number ``cut_no`` comes after the
    first ``need`` rows. A row of a group without cuts gets null. ``levels`` are
    coarse columns that never decrease along ``order`` (a hash prefix, a rounded
    score): each pass counts rows per level value and goes on with the one value
    in which a cut falls, so that only a sliver of a group is ever ranked. Every
    pass is a scan with a map-side aggregate; the rows themselves are never
    shuffled. ``order`` must be a total order without nulls.
    """
    keys = list(keys)
    names = [f"_l{i}" for i in range(len(levels))]
    d = df.withColumns({**dict(zip(names, levels)), "_o": F.struct(*order)})
    if not keys:
        # A key that is the same for all rows but not a constant, so that joins on it stay hash joins.
        d, cuts, keys = d.withColumn("_all", F.col("_o").isNull()), cuts.withColumn("_all", F.col("need").isNull()), ["_all"]
    cuts, small = sized_table(cuts.select(*keys, "cut_no", F.col("need").cast("bigint").alias("need")))
    # Every table below has at most one row a cut, so it is as small as the cuts were found to be.
    hint = F.broadcast if small else (lambda t: t)
    rows, group, goal = d.select(*keys, *names, "_o"), keys, cuts.where(F.col("need") > 0)
    for i, name in enumerate(names):
        running = Window.partitionBy(*group).orderBy(name).rowsBetween(Window.unboundedPreceding, 0)
        hist = rows.groupBy(*group, name).agg(F.count(F.lit(1)).alias("_n")).withColumn("_cum", F.sum("_n").over(running))
        goal = (hist.join(goal, group).where((F.col("_cum") >= F.col("need")) & (F.col("_cum") - F.col("_n") < F.col("need")))
                .select(*keys, "cut_no", name, (F.col("need") - F.col("_cum") + F.col("_n")).alias("need")))
        # Every other level is fetched, so that plans of many levels do not contain each other.
        goal = sized_table(goal)[0] if i % 2 and i + 1 < len(names) else hint(goal)
        rows = rows.join(goal.drop("need"), [c for c in rows.columns if c in (*group, name)])
        goal, group = goal.drop(name), [*keys, "cut_no"]
    rank = F.row_number().over(Window.partitionBy(*group).orderBy("_o"))
    found = (rows.withColumn("_r", rank).join(goal, group).where(F.col("_r") == F.col("need"))
             .select(*group, F.struct(*names, "_o").alias("_cut")))
    lists = hint(cuts.join(found, [*keys, "cut_no"], "left").groupBy(*keys)
                 .agg(F.collect_list(F.struct("need", "_cut")).alias("_cuts")))
    here = F.struct(*names, "_o")
    behind = F.filter("_cuts", lambda c: (c["need"] <= 0) | F.coalesce(c["_cut"] < here, F.lit(False)))
    return (d.join(lists, keys, "left").withColumn(band, F.when(F.col("_cuts").isNotNull(), F.size(behind)))
            .select(*df.columns, band))


def mark_head(df: DataFrame, keys: Sequence[str], quota: DataFrame, order: Sequence[Column],
              levels: Sequence[Column], flag: str = "in_head") -> DataFrame:
    """Add ``flag``: true for the first ``quota`` rows of each group. ``quota`` is a small table (keys, quota)."""
    cuts = quota.select(*keys, F.lit(0).alias("cut_no"), F.col("quota").alias("need"))
    marked = mark_bands(df, keys, cuts, order, levels, "_band")
    return marked.withColumn(flag, F.coalesce(F.col("_band") == 0, F.lit(False))).drop("_band")


def same_quota(df: DataFrame, keys: Sequence[str], n: int) -> DataFrame:
    """The quota table that gives every group of ``df`` the same number."""
    if not keys:
        return df.sparkSession.range(1).select(F.lit(n).alias("quota"))
    return df.select(*keys).distinct().withColumn("quota", F.lit(n))


def sample_per_group(df: DataFrame, keys: Sequence[str], quota: DataFrame | int, seed: int, id_col: str) -> DataFrame:
    """The ``quota`` rows of each group with the smallest id hash (a seeded random sample)."""
    quota = same_quota(df, keys, quota) if isinstance(quota, int) else quota
    h = df.withColumn("_h", sample_hash(seed, id_col))
    marked = mark_head(h, keys, quota, [F.col("_h"), F.col(id_col)], hash_levels("_h"))
    return marked.where("in_head").select(*df.columns)


def head_global(df: DataFrame, quota: DataFrame, score: str, id_col: str) -> DataFrame:
    """First ``quota`` rows by score (0 to 1) descending, then id hash, however large the quota.

    The score is narrowed twelve binary digits at a time, then to one value,
    then to a hash prefix: no step sees many distinct values, even if all scores
    are close to 1, and a third of all rows may share one score.
    """
    d = df.withColumns({"_neg": -F.col(score), "_h": sample_hash(0, id_col)})
    levels = [*[F.floor(F.col("_neg") * float(1 << b)) for b in (12, 24, 36)], F.col("_neg"), *hash_levels("_h")]
    marked = mark_head(d, [], quota, [F.col("_neg"), F.col("_h"), F.col(id_col)], levels)
    return marked.where("in_head").select(*df.columns)
