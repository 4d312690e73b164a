"""Quotas, seeded samples and leak-safe splits.

All random choices take the rows with the smallest md5(seed|id), so a sample is
the same on any cluster and any partitioning. Quotas are computed on group
counts (one row per class), never on rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.labels import CLASSES, COUNTRIES, actor_type, class_code, example_quality
from ..functions.tables import CONTROL_ROWS, control_table, stored
from .ranking import hash_levels, mark_bands, mark_head, sample_hash, sample_per_group


def largest_remainder(counts: DataFrame, n: Column, group: str, part: list[str] | None = None,
                      count: str = "n", out: str = "alloc") -> DataFrame:
    """Share ``n`` slots among groups in proportion to their counts.

    Floors first; the slots left over go to the largest fractions, ties to the
    larger group and then by name. ``n`` is a column that is constant in a part.
    """
    part = part or []
    whole = Window.partitionBy(*part) if part else Window.partitionBy(F.lit(0))
    total = F.sum(count).over(whole)
    d = counts.withColumn("_slots", n.cast("bigint")).withColumn("_total", total)
    d = d.withColumn("_ideal", F.when((F.col("_total") > 0) & (F.col("_slots") > 0),
                                      F.col(count).cast("double") / F.col("_total").cast("double")
                                      * F.col("_slots").cast("double")).otherwise(0.0))
    d = d.withColumn("_floor", F.floor("_ideal"))
    order = whole.orderBy((F.col("_ideal") - F.col("_floor")).desc(), F.col(count).desc(), F.col(group))
    d = (d.withColumn("_left", F.col("_slots") - F.sum("_floor").over(whole))
         .withColumn("_rn", F.row_number().over(order)))
    extra = F.when((F.col("_rn") <= F.col("_left")) & (F.col("_total") > 0) & (F.col("_slots") > 0), 1).otherwise(0)
    return (d.withColumn(out, (F.col("_floor") + extra).cast("bigint"))
            .drop("_slots", "_total", "_ideal", "_floor", "_left", "_rn"))


def class_counts(df: DataFrame, group: str) -> DataFrame:
    return df.groupBy(F.coalesce(F.col(group), F.lit("")).alias(group)).agg(F.count(F.lit(1)).alias("n"))


def stratified_quota(df: DataFrame, group: str, n_total: int, primary: str | None = None,
                     primary_share: float = 0.6, replace: bool = False) -> DataFrame:
    """(group, n, quota): a reserved share for the primary group, the rest proportional.

    What a group cannot fill goes to groups with rows to spare, again by largest
    remainder. With ``replace`` a quota may exceed the rows of its group.
    """
    one = Window.partitionBy(F.lit(0))
    is_primary = F.col(group) == F.lit(primary) if primary is not None else F.lit(False)
    c = class_counts(df, group).withColumn("_p", F.coalesce(is_primary, F.lit(False)))
    c = c.withColumn("_want", F.least(F.lit(n_total).cast("bigint"), F.sum("n").over(one)))
    c = c.withColumn("_prim", F.max(F.when(F.col("_p"), F.least(F.floor(F.col("_want") * F.lit(primary_share)),
                                                                F.col("n"))).otherwise(0)).over(one))
    others = c.where(~F.col("_p"))
    others = largest_remainder(others, F.col("_want") - F.col("_prim"), group)
    prim = c.where("_p").select(group, "n", F.col("_prim").cast("bigint").alias("quota"))
    if replace:
        return others.select(group, "n", F.col("alloc").alias("quota")).unionByName(prim)
    others = others.withColumns({
        "_spare": F.greatest(F.lit(0).cast("bigint"), F.col("n") - F.col("alloc")),
        "_unfilled": F.sum(F.greatest(F.lit(0).cast("bigint"), F.col("alloc") - F.col("n"))).over(one)})
    others = largest_remainder(others, F.col("_unfilled"), group, count="_spare", out="_extra")
    others = others.select(group, "n", (F.least("alloc", "n") + F.least("_extra", "_spare")).alias("quota"))
    return others.unionByName(prim)


def stratified_sample(df: DataFrame, group: str, n_total: int, primary: str | None = None,
                      primary_share: float = 0.6, seed: int = 42, id_col: str = "event_id",
                      replace: bool = False) -> DataFrame:
    """Sample with the quotas above.

    ``replace=True`` draws the primary group, and every group smaller than its
    quota, with replacement.
    """
    d = df.withColumn(group, F.coalesce(F.col(group), F.lit("")))
    quota = stratified_quota(d, group, n_total, primary, primary_share, replace)
    if not replace:
        return sample_per_group(d, [group], quota.select(group, "quota"), seed, id_col)
    again = (F.col("quota") > F.col("n")) | (F.col(group) == F.lit(primary) if primary else F.lit(False))
    quota = control_table(quota)
    once = sample_per_group(d, [group], quota.where(~again).select(group, "quota"), seed, id_col)
    return once.unionByName(_draw_again(d, group, quota.where(again & (F.col("quota") > 0)), seed, id_col))


def _draw_again(df: DataFrame, group: str, quota: DataFrame, seed: int, id_col: str) -> DataFrame:
    """Draws with replacement: draw i of a group asks for one rank of its rows.

    Rows are ranked inside hash slices of their group, and a running count of
    slice sizes turns that into a rank of the group.
    """
    h = df.join(quota.select(group), group, "left_semi").withColumn("_h", sample_hash(seed, id_col))
    h = h.withColumn("_b", F.substring("_h", 1, 3))
    before = Window.partitionBy(group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    base = (h.groupBy(group, "_b").agg(F.count(F.lit(1)).alias("_n"))
            .withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n"))
    inner = F.row_number().over(Window.partitionBy(group, "_b").orderBy("_h", id_col))
    ranked = h.withColumn("_r", inner).join(control_table(base), [group, "_b"]).withColumn("_rank", F.col("_base") + F.col("_r"))
    draws = quota.select(group, "n", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("quota"))).alias("_i"))
    draws = draws.select(group, (F.pmod(F.xxhash64(F.lit(seed), F.col(group), F.col("_i")), F.col("n")) + 1).alias("_rank"))
    return ranked.join(control_table(draws, 10 * CONTROL_ROWS), [group, "_rank"]).select(*df.columns)


def balanced_actor_quota(df: DataFrame, event: str, actor_code: str, n_total: int, balance_ratio: float = 0.5,
                         event_types: list[str] | None = None, min_per_cell: int = 30,
                         primary: str | None = "Violence against civilians",
                         primary_share: float | None = None) -> DataFrame:
    """(event, actor_type, n, quota): state and non-state halves, each spread over event types.

    Without ``event_types`` a type is used when both halves hold at least
    ``min_per_cell`` rows. A quota is never above what the cell holds.
    """
    cells = (df.where(F.col(event).isNotNull()).groupBy(event, actor_type(actor_code).alias("actor_type"))
             .agg(F.count(F.lit(1)).alias("n")))
    by_type = cells.groupBy(event).agg(
        F.sum(F.when(F.col("actor_type") == "state", F.col("n")).otherwise(0)).alias("state"),
        F.sum(F.when(F.col("actor_type") != "state", F.col("n")).otherwise(0)).alias("non_state"))
    if event_types is None:
        by_type = by_type.where((F.col("state") >= min_per_cell) & (F.col("non_state") >= min_per_cell))
    else:
        by_type = by_type.where(F.col(event).isin(event_types))
    grid = by_type.select(event, F.explode(F.array(
        F.struct(F.lit("state").alias("actor_type"), F.col("state").alias("n")),
        F.struct(F.lit("non-state").alias("actor_type"), F.col("non_state").alias("n")))).alias("_c")).select(event, "_c.*")
    n_state = int(n_total * balance_ratio)
    grid = grid.withColumn("_half", F.when(F.col("actor_type") == "state", n_state).otherwise(n_total - n_state))
    half = Window.partitionBy("actor_type")
    is_primary = F.col(event) == F.lit(primary) if primary and primary_share else F.lit(False)
    grid = grid.withColumn("_p", is_primary)
    grid = grid.withColumn("_prim", F.max(F.when(
        F.col("_p"), F.least(F.floor(F.col("_half") * F.lit(float(primary_share or 0.0))), F.col("n"))).otherwise(0)).over(half))
    rest = largest_remainder(grid.where(~F.col("_p")), F.col("_half") - F.col("_prim"), event, ["actor_type"])
    rest = rest.select(event, "actor_type", "n", F.least("alloc", "n").alias("quota"))
    prim = grid.where("_p").select(event, "actor_type", "n", F.col("_prim").cast("bigint").alias("quota"))
    return rest.unionByName(prim)


def balanced_actor_sample(df: DataFrame, event: str, actor_code: str, n_total: int, seed: int = 42,
                          id_col: str = "event_id", **quota_args) -> DataFrame:
    """Sample of the cells above, with actor_type and the class code added."""
    quota = balanced_actor_quota(df, event, actor_code, n_total, **quota_args)
    d = df.where(F.col(event).isNotNull()).withColumn("actor_type", actor_type(actor_code))
    return (sample_per_group(d, [event, "actor_type"], quota.select(event, "actor_type", "quota"), seed, id_col)
            .withColumn("gold_label", class_code(event)))


def cap_per_class(df: DataFrame, n: int, group: str = "event_type", seed: int = 42,
                  id_col: str = "event_id") -> DataFrame:
    return sample_per_group(df, [group], n, seed, id_col)


def smallest_class_quota(df: DataFrame, group: str = "event_type") -> DataFrame:
    counts = df.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("quota", F.min("n").over(Window.partitionBy(F.lit(0))))


def balance_classes(df: DataFrame, group: str = "event_type", seed: int = 42, id_col: str = "event_id") -> DataFrame:
    """Every class cut to the size of the smallest."""
    return sample_per_group(df, [group], smallest_class_quota(df, group).select(group, "quota"), seed, id_col)


def dev_quota(df: DataFrame, ratio: float, group: str = "event_type") -> DataFrame:
    """Dev rows per class: half-even rounding, at least one, never the whole class."""
    n = F.col("n")
    rounded = F.bround(n.cast("double") * F.lit(float(ratio))).cast("bigint")
    return (df.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
            .withColumn("quota", F.when(n > 1, F.least(F.greatest(rounded, F.lit(1).cast("bigint")), n - 1)).otherwise(0)))


def train_dev_split(df: DataFrame, ratio: float = 0.1, group: str = "event_type", seed: int = 42,
                    id_col: str = "event_id") -> DataFrame:
    """Add ``split`` (train or dev), stratified by class."""
    h = df.withColumn("_h", sample_hash(seed, id_col))
    marked = mark_head(h, [group], dev_quota(df, ratio, group).select(group, "quota"),
                       [F.col("_h"), F.col(id_col)], hash_levels("_h"), "_dev")
    return marked.withColumn("split", F.when(F.col("_dev"), "dev").otherwise("train")).select(*df.columns, "split")


def split_bundle(std: DataFrame, eval_codes: list[str], dev_ratio: float = 0.1, seed: int = 42,
                 include_eval_in_train: bool = False, balance_train: bool = False, balance_dev: bool = False,
                 balance_test: bool = False, train_max_per_class: int = 0, dev_max_per_class: int = 0,
                 test_max_per_country: int = 0, countries: dict[str, str] = COUNTRIES) -> DataFrame:
    """Standard events with a ``split`` column: train, dev and one test split per held-out country.

    Evaluation countries leave the training pool. All splits of a class are
    bands of one hash order (dev first, then train), so one counting pass gives
    every quota and one marking pass every split. The passes read a stored table
    of ids, classes and countries; texts are joined back at the end. Check the
    result with :func:`leakage` (ids may be in several splits only when
    ``include_eval_in_train`` is set).
    """
    unknown = [c for c in eval_codes if c not in countries]
    if unknown:
        raise ValueError(f"unsupported country codes: {unknown}")
    held = {countries[c].lower(): f"test_{c}" for c in eval_codes}
    narrow = stored(std.select("event_id", "event_type", F.lower("country").alias("_c")))
    test_of = F.coalesce(*[F.when(F.col("_c") == name, F.lit(split)) for name, split in held.items()])
    train_pool = F.lit("train") if include_eval_in_train else F.when(test_of.isNull(), "train")
    pools = F.array_compact(F.array(train_pool, test_of))
    units = narrow.select("event_id", "event_type", F.explode(pools).alias("pool"))
    by_class = F.col("pool") == "train" if not balance_test else F.lit(True)
    units = units.withColumn("unit", F.when(by_class, F.col("event_type")).otherwise(F.lit("")))

    n = F.col("n")
    c = units.groupBy("pool", "unit").agg(F.count(F.lit(1)).alias("n"))
    is_train = F.col("pool") == "train"
    half_even = F.bround(n.cast("double") * F.lit(float(dev_ratio))).cast("bigint")
    c = c.withColumn("dev", F.when(is_train & (n > 1), F.least(F.greatest(half_even, F.lit(1).cast("bigint")), n - 1)).otherwise(0))
    c = c.withColumn("rest", n - F.col("dev"))
    pool = Window.partitionBy("pool")

    def quota(size: str, balance: bool, cap: int) -> Column:
        """Rows to keep of a class; balancing goes by the smallest class that has any."""
        smallest = F.min(F.when(F.col(size) > 0, F.col(size))).over(pool)
        out = F.when(F.col(size) > 0, smallest).otherwise(0) if balance else F.col(size)
        return F.least(out, F.lit(cap).cast("bigint")) if cap > 0 else out

    test_cap = 0 if balance_test else test_max_per_country
    c = c.withColumns({"q_dev": quota("dev", balance_dev, dev_max_per_class),
                       "q_train": quota("rest", balance_train, train_max_per_class),
                       "q_test": quota("n", balance_test, test_cap)})
    needs = F.when(is_train, F.array(F.col("q_dev"), F.col("dev"), F.col("dev") + F.col("q_train"))).otherwise(F.array(F.col("q_test")))
    cuts = c.select("pool", "unit", F.posexplode(needs).alias("cut_no", "need"))
    h = units.withColumn("_h", sample_hash(seed, "event_id"))
    marked = mark_bands(h, ["pool", "unit"], cuts, [F.col("_h"), F.col("event_id")], hash_levels("_h"))
    split = (F.when(is_train & (F.col("band") == 0), "dev").when(is_train & (F.col("band") == 2), "train")
             .when(~is_train & (F.col("band") == 0), F.col("pool")))
    chosen = marked.select("event_id", split.alias("split")).where(F.col("split").isNotNull())
    if balance_test and test_max_per_country > 0:
        tests = sample_per_group(chosen.where("split like 'test%'"), ["split"], test_max_per_country, seed, "event_id")
        chosen = chosen.where("split not like 'test%'").unionByName(tests)
    return std.join(chosen, "event_id").select(*std.columns, "split")


def leakage(splits: DataFrame, id_col: str = "event_id", split: str = "split") -> DataFrame:
    """(split_a, split_b, n_shared): ids found in two splits, one shuffle for all pairs."""
    shared = (splits.groupBy(id_col).agg(F.array_sort(F.collect_set(split)).alias("_s"))
              .where(F.size("_s") > 1).groupBy("_s").agg(F.count(F.lit(1)).alias("_n")))
    pairs = F.flatten(F.transform("_s", lambda a, i: F.transform(
        F.slice("_s", i + 2, F.size("_s")), lambda b: F.struct(a.alias("split_a"), b.alias("split_b")))))
    return (shared.select(F.explode(pairs).alias("_p"), "_n").select("_p.*", "_n")
            .groupBy("split_a", "split_b").agg(F.sum("_n").alias("n_shared")))


def assert_no_leakage(splits: DataFrame, id_col: str = "event_id") -> None:
    bad = leakage(splits, id_col).take(1)
    if bad:
        raise ValueError(f"leakage: {bad[0]['n_shared']} ids shared by {bad[0]['split_a']} and {bad[0]['split_b']}")


def without_ids(df: DataFrame, taken: DataFrame, id_col: str = "event_id") -> DataFrame:
    """Rows whose id is not in ``taken``."""
    return df.join(taken.select(id_col), id_col, "left_anti")


def few_shot_picks(df: DataFrame, n_train: int, n_val: int, seed: int = 42, id_col: str = "event_id") -> DataFrame:
    """Best notes per class: the first ``n_train`` are train, the next ``n_val`` are val.

    Order: quality, length, id hash. Both numbers are literals, so each task
    keeps only that many rows per class before the shuffle.
    """
    d = df.where(F.col("notes").isNotNull() & F.col("event_type").isin(CLASSES))
    d = d.withColumn("notes_len", F.length("notes")) if "notes_len" not in d.columns else d
    d = d.withColumn("quality_score", example_quality("notes_len", "actor_norm"))
    w = Window.partitionBy("event_type").orderBy(F.desc("quality_score"), F.desc("notes_len"),
                                                 sample_hash(seed, id_col), F.col(id_col))
    d = d.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n_train + n_val)
    return d.withColumn("split", F.when(F.col("_r") <= n_train, "train").otherwise("val")).drop("_r")


def calibration_split(df: DataFrame, test_share: float = 0.2, seed: int = 42, id_col: str = "event_id") -> DataFrame:
    """Add is_train / is_test per model: ceil(share·n) test rows; fewer than two rows serve as both."""
    n = F.col("n")
    quota = (df.groupBy("model").agg(F.count(F.lit(1)).alias("n"))
             .withColumn("quota", F.when(n < 2, n).otherwise(F.ceil(n * F.lit(test_share)))))
    quota = control_table(quota)
    h = df.join(quota.select("model", (n < 2).alias("_tiny")), "model").withColumn("_h", sample_hash(seed, id_col))
    marked = mark_head(h, ["model"], quota.select("model", "quota"), [F.col("_h"), F.col(id_col)],
                       hash_levels("_h"), "is_test")
    return marked.withColumn("is_train", F.col("_tiny") | ~F.col("is_test")).select(*df.columns, "is_train", "is_test")


def class_distribution(splits: DataFrame, group: str = "event_type") -> DataFrame:
    return splits.groupBy("split", group).agg(F.count(F.lit(1)).alias("n"))


def event_actor_crosstab(df: DataFrame, event: str, actor_code: str, min_per_cell: int = 0) -> DataFrame:
    """state / non_state counts per event type, keeping types with enough rows in both."""
    t = actor_type(actor_code)
    c = df.where(F.col(event).isNotNull()).groupBy(event).agg(
        F.sum(F.when(t == "state", 1).otherwise(0)).alias("state"),
        F.sum(F.when(t != "state", 1).otherwise(0)).alias("non_state"))
    return c.where((F.col("state") >= min_per_cell) & (F.col("non_state") >= min_per_cell))


def manifest(splits: DataFrame) -> DataFrame:
    """Row counts and class distribution per split; the parameters are added by the sink."""
    d = class_distribution(splits)
    return (d.groupBy("split").agg(F.sum("n").alias("n_rows"),
                                   F.map_from_entries(F.array_sort(F.collect_list(F.struct("event_type", "n")))).alias("classes")))


def head(df: DataFrame, n: int) -> DataFrame:
    return df.limit(n)
