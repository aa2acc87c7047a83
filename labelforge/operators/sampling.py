"""Deterministic, partition-independent sampling, balancing and splitting.

Randomness is a seeded md5 of the row key, so every engine and every
partitioning picks the same rows. Exact-size selections, quotas and splits
find the key of the last chosen row by histograms over the key column and are
then a comparison per row, for any size. A distributed global position (range
sort + per-partition offsets) serves shuffles only, on the id column.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import col_of
from .common import stored


def hash_key(id_col, seed) -> Column:
    """Seeded sort key: ``md5('<seed>:<id>')``."""
    return F.md5(F.concat(F.lit(f"{seed}:"), col_of(id_col).cast("string")))


def hash_uniform(id_col, seed) -> Column:
    """Uniform [0, 1) value from the first 8 hex digits of the seeded md5."""
    return F.conv(F.substring(hash_key(id_col, seed), 1, 8), 16, 10).cast("long") / 4294967296.0


BUCKETS = 1 << 16
NO_KEY = 1 << 40  # the bucket of null keys, behind all others
HASH_TOP = 1 << 60


def hash_ordinal(id_col, seed) -> Column:
    """The first 60 bits of the seeded md5 as a number, in the md5's order."""
    return F.conv(F.substring(hash_key(id_col, seed), 1, 15), 16, 10).cast("long")


def mark_first(df: DataFrame, quota, ordinal: Column, ties: list, name: str,
               by: str | None = None, top: int | None = None) -> DataFrame:
    """Add the boolean ``name``: the row is among the first ``quota`` rows in
    the order (ordinal, *ties), per value of ``by`` when given. Exactly
    ``min(quota, rows)`` rows are marked: rows with a null ordinal come last,
    and rows that share the key of the last chosen row are told apart by a hash
    of the whole row (of equal rows any are taken).

    ``quota`` is a number or a function (by column, group size) -> Column. The
    row in question is found on the key columns alone, which are stored
    once: a histogram of ``BUCKETS`` equal key ranges, then one of the bucket
    that holds it, then the counts of the few keys of that range. Its key, one
    row per group, is stored as well and compared with every row. Rows are
    sorted only where the cutoff's key repeats and not all of its rows are
    chosen, or where the quota reaches into the null keys: those rows alone, one
    task per group. ``top``: ordinals are known to lie in [0, top); else their
    range is aggregated first.
    """
    rule = quota if callable(quota) else (lambda _, __: F.lit(quota))
    tie = [f"_t{i}" for i in range(len(ties))]
    keys = df.select(F.col(by).alias("_by") if by else F.lit(0).alias("_by"), ordinal.cast("long").alias("_o"),
                     *[col_of(t).alias(n) for t, n in zip(ties, tie)])
    keys = stored(keys, "keys")
    if top is None:
        ends = keys.agg(F.min("_o").alias("_lo"), F.max("_o").alias("_hi"))  # one row
        keys = keys.crossJoin(F.broadcast(ends))
        width = F.floor(F.col("_hi") / BUCKETS - F.col("_lo") / BUCKETS).cast("long") + 1
    else:
        keys = keys.withColumn("_lo", F.lit(0).cast("long"))
        width = F.lit(top // BUCKETS).cast("long")
    keys = (keys.withColumn("_w", width).withColumn("_d", F.col("_o") - F.col("_lo"))
            .withColumn("_b1", F.coalesce(F.floor(F.col("_d") / F.col("_w")), F.lit(NO_KEY)))
            .withColumn("_in", F.col("_d") - F.col("_b1") * F.col("_w"))
            .withColumn("_b2", F.floor(F.col("_in") / (F.floor(F.col("_w") / BUCKETS) + 1))))

    def sized(h: DataFrame) -> DataFrame:
        """Rows of a group, those with a key, and how many are wanted."""
        group = Window.partitionBy("_by")
        live = F.when(F.col("_b1") < NO_KEY, F.col("_n"))
        return (h.withColumn("_size", F.sum("_n").over(group))
                .withColumn("_live", F.coalesce(F.sum(live).over(group), F.lit(0)))
                .withColumn("_want", rule(F.col("_by"), F.col("_size")).cast("long")))

    def bucket(rows: DataFrame, cols: list[str], before: Column, keep: list[str]) -> DataFrame:
        """The bucket in which the wanted row lies, one row per group."""
        w = Window.partitionBy("_by").orderBy(cols[-1])  # at most BUCKETS + 1 rows of a group
        h = rows.groupBy("_by", *cols, *keep).agg(F.count(F.lit(1)).alias("_n"))
        h = h.withColumn("_cum", F.sum("_n").over(w) + before)
        if "_need" not in keep:
            h = sized(h).withColumnRenamed("_want", "_need").where(F.col("_b1") < NO_KEY)
        return h.where((F.col("_cum") - F.col("_n") < F.col("_need")) & (F.col("_need") <= F.col("_cum"))).select(
            F.col("_by").alias("_g"), *[F.col(c).alias(f"{c}_at") for c in cols],
            (F.col("_cum") - F.col("_n")).alias("_before"), "_need")

    def same(cols) -> Column:
        cond = F.col("_by").eqNullSafe(F.col("_g"))
        for c in cols:
            cond &= F.col(c) == F.col(f"{c}_at")
        return cond

    def narrow(rows: DataFrame, at: DataFrame, cols) -> DataFrame:
        at = at if by else F.broadcast(at)  # without groups: one row
        return rows.join(at, same(cols)).drop("_g", *[f"{c}_at" for c in cols])

    inner = narrow(keys, bucket(keys, ["_b1"], F.lit(0), []), ["_b1"])
    two = bucket(inner, ["_b1", "_b2"], F.col("_before"), ["_before", "_need"])
    last = narrow(keys, two, ["_b1", "_b2"])
    order = Window.partitionBy("_by").orderBy("_o", *tie)  # the keys of one range of the second histogram
    cut = (last.groupBy("_by", "_o", *tie, "_before", "_need").agg(F.count(F.lit(1)).alias("_n"))
           .withColumn("_cum", F.sum("_n").over(order) + F.col("_before"))
           .where((F.col("_cum") - F.col("_n") < F.col("_need")) & (F.col("_need") <= F.col("_cum")))
           .select(F.col("_by").alias("_g"), F.col("_o").alias("_co"), *[F.col(t).alias(f"_c{t}") for t in tie],
                   (F.col("_need") - F.col("_cum") + F.col("_n")).alias("_take"), "_n"))
    sizes = (sized(keys.groupBy("_by", "_b1").agg(F.count(F.lit(1)).alias("_n")))  # the first histogram again
             .groupBy(F.col("_by").alias("_gs")).agg(*[F.max(c).alias(c) for c in ("_size", "_live", "_want")]))
    limits = sizes.join(cut, F.col("_gs").eqNullSafe(F.col("_g")), "left").drop("_g")
    some = (F.col("_want") > 0) & (F.col("_want") < F.col("_size"))
    nulls = some & (F.col("_want") > F.col("_live"))  # all rows with a key, and some without
    limits = limits.select(
        "_gs", "_size", "_live", "_want", "_co", *[f"_c{t}" for t in tie], nulls.alias("_nulls"),
        F.when(nulls, F.col("_want") - F.col("_live")).otherwise(F.col("_take")).alias("_take"),
        F.coalesce(nulls | (some & (F.col("_take") < F.col("_n"))), F.lit(False)).alias("_part"))
    o = ordinal.cast("long")
    below, equal = o < F.col("_co"), o == F.col("_co")
    for t, n in zip(ties, tie):
        t, c = col_of(t), F.col(f"_c{n}")
        below = below | (equal & ((t.isNull() & c.isNotNull()) | F.coalesce(t < c, F.lit(False))))
        equal = equal & t.eqNullSafe(c)
    tied = F.when(F.col("_nulls"), o.isNull()).otherwise(F.coalesce(equal, F.lit(False)))
    chosen = (F.when(F.col("_want") >= F.col("_size"), F.lit(True)).when(F.col("_want") <= 0, F.lit(False))
              .when(F.col("_nulls"), o.isNotNull()).otherwise(F.coalesce(below | equal, F.lit(False))))
    limits = stored(limits, "limits")  # one row per group
    own = [df[c] for c in df.columns]
    on = F.col(by).eqNullSafe(F.col("_gs")) if by else F.lit(True)
    most = limits if by else F.broadcast(limits)  # without groups one row (none if df is empty)
    plain = df.join(most, on, "left" if by else "inner")
    if limits.where("_part").isEmpty():
        return plain.select(*own, chosen.alias(name))
    plain = plain.where(~(F.col("_part") & tied)).select(*own, chosen.alias(name))
    some_tied = df.join(limits.where("_part") if by else most, on).where(tied)
    rank = F.row_number().over(Window.partitionBy("_gs").orderBy(F.xxhash64(*own) if own else F.lit(0)))
    return plain.unionByName(some_tied.select(*own, (rank <= F.col("_take")).alias(name)))


def first_n(df: DataFrame, n: int, order_col: str) -> DataFrame:
    """The first ``n`` rows by an explicit integer key, exactly
    ``min(n, rows with a key)`` (rows without a key are never among them; of
    rows that share the last key, the first by a hash of the whole row)."""
    keyed = df.where(F.col(order_col).isNotNull())
    return mark_first(keyed, n, F.col(order_col), [order_col], "_first").where("_first").drop("_first")


def sample_n(df: DataFrame, n: int, id_col: str, seed: int = 42) -> DataFrame:
    """Exactly ``min(n, count)`` rows chosen uniformly by seeded hash of the
    id; rows without an id come last, rows that share an id stand together.

    ``n == -1`` keeps all rows, ``n == 0`` none.
    """
    if n < 0:
        return df
    if n == 0:
        return df.limit(0)
    marked = mark_first(df, n, hash_ordinal(id_col, seed), [hash_key(id_col, seed), id_col], "_first", top=HASH_TOP)
    return marked.where("_first").drop("_first")


def cap_per_class(df: DataFrame, class_col: str, quotas: dict[int, int], order_col: str,
                  unlimited: tuple = (5,)) -> DataFrame:
    """Keep the first ``quotas[c]`` rows of each capped class ``c`` (by the
    integer key ``order_col``, rows without a key last) and every row of the
    ``unlimited`` classes; rows of any other class (and nulls) are dropped."""
    rest = df.filter(F.col(class_col).isin(list(unlimited)))
    if not quotas:
        return rest
    qmap = F.create_map(*[x for k, v in quotas.items() for x in (F.lit(k), F.lit(v))])
    sub = df.filter(F.col(class_col).isin(list(quotas)))
    marked = mark_first(sub, lambda c, _: F.element_at(qmap, c), F.col(order_col), [order_col], "_first", by=class_col)
    return rest.unionByName(marked.where("_first").drop("_first"))


def global_position(df: DataFrame, order_cols: list, name: str = "pos",
                    num_partitions: int | None = None) -> DataFrame:
    """1-based position of each row in the total order ``order_cols``.

    Distributed: range-partition + sort within partitions, checkpoint to the
    shared checkpoint folder (fixes partition contents and cuts lineage),
    count rows per partition (one row per partition reaches the driver) and
    add the partition's offset via a broadcast of those counts.
    """
    spark = df.sparkSession
    n = num_partitions or max(spark.sparkContext.defaultParallelism, 1)
    ranged = (df.repartitionByRange(n, *order_cols).sortWithinPartitions(*order_cols)
              .withColumn("_pid", F.spark_partition_id())
              .withColumn("_mid", F.monotonically_increasing_id()))
    ranged = ranged.checkpoint(eager=True)
    counts = sorted((r["_pid"], r["n"]) for r in
                    ranged.groupBy("_pid").agg(F.count(F.lit(1)).alias("n")).collect())
    offs, acc = [], 0
    for pid, c in counts:
        offs.append((pid, acc))
        acc += c
    off_df = spark.createDataFrame(offs or [(0, 0)], "_pid int, _off long")
    return (ranged.join(F.broadcast(off_df), "_pid")
            .withColumn(name, F.col("_off") + (F.col("_mid") - F.shiftleft(F.col("_pid").cast("long"), 33)) + 1)
            .drop("_pid", "_mid", "_off"))


def train_val_split(df: DataFrame, val_fraction: float, id_col: str, seed: int = 42,
                    stratify_col: str | None = None) -> DataFrame:
    """Add ``split`` in {'train', 'validation'}: the first
    ``floor((1 - v) * n)`` rows by seeded hash are train (per stratum when
    ``stratify_col`` is given)."""
    part = lambda _, size: F.floor((1 - F.lit(val_fraction)) * size)
    marked = mark_first(df, part, hash_ordinal(id_col, seed), [hash_key(id_col, seed), id_col], "_first",
                        by=stratify_col, top=HASH_TOP)
    return marked.withColumn("split", F.when(F.col("_first"), F.lit("train")).otherwise(F.lit("validation"))).drop(
        "_first")


def apportion(sizes: dict, total: int) -> dict:
    """``total`` seats over classes in proportion to their sizes, by largest
    remainders; equal remainders by the order of ``sizes``."""
    every = sum(sizes.values())
    if not every:
        return {c: 0 for c in sizes}
    seats = {c: total * n // every for c, n in sizes.items()}
    by_rest = sorted(sizes, key=lambda c: -(total * sizes[c] % every))  # stable
    for c in by_rest[:total - sum(seats.values())]:
        seats[c] += 1
    return seats


def stratified_split(df: DataFrame, val_fraction: float, id_col: str, stratify_col: str, seed: int = 42) -> DataFrame:
    """Add ``split``: of all n rows exactly ``floor((1 - v) * n)`` are train,
    shared out over the classes by largest remainders (equal ones by class,
    nulls last); inside a class the first rows by seeded hash. One row per class
    reaches the driver."""
    counts = df.groupBy(stratify_col).agg(F.count(F.lit(1)).alias("n")).orderBy(
        F.col(stratify_col).asc_nulls_last()).collect()
    sizes = {r[0]: r["n"] for r in counts}
    seats = apportion(sizes, math.floor((1 - val_fraction) * sum(sizes.values())))
    name = F.coalesce(F.concat(F.lit("="), F.col(stratify_col).cast("string")), F.lit(""))  # null is a class
    if not sizes:
        return df.withColumn("split", F.lit("train"))
    texts = df.sparkSession.createDataFrame(
        [(c, n) for c, n in seats.items()], T.StructType([df.schema[stratify_col], T.StructField("seats", T.LongType())])
    ).select(name.alias("name"), "seats").collect()
    quota = F.create_map(*[F.lit(x) for r in texts for x in (r["name"], r["seats"])])
    marked = mark_first(df.withColumn("split class", name), lambda by, _: F.element_at(quota, by),
                        hash_ordinal(id_col, seed), [hash_key(id_col, seed), id_col], "_first", by="split class", top=HASH_TOP)
    return marked.withColumn("split", F.when(F.col("_first"), F.lit("train")).otherwise(F.lit("validation"))).drop(
        "_first", "split class")


def biased_sample(df: DataFrame, n, bias: float, id_col: str, labels_col: str,
                  flag_col: str, seed: int = 42, topup_seed: int = 43,
                  min_labels: int = 2, must: str = "Excellent", maybe: str = "Good") -> DataFrame:
    """Evaluation sample: rows with a ``must`` label, plus rows with a
    ``maybe`` label kept with probability ``bias`` (seeded hash), topped up to
    ``n`` with the lowest-hash other rows (``n`` is a number or a quota function
    of :func:`mark_first`); returned with a seeded shuffle
    position ``pos``. When the kept rows already number >= n they are all
    returned (always a frame)."""
    base = df.filter((F.col(flag_col) == F.lit(False)) & (F.size(labels_col) > min_labels))
    keep = (F.array_contains(labels_col, must)
            | (F.array_contains(labels_col, maybe) & (hash_uniform(id_col, seed) <= bias)))
    base = base.withColumn("_keep", keep)
    # Kept rows first, the others behind them by a second seeded hash: the
    # first n rows are the kept ones and the top-up, if there is need of one.
    half = HASH_TOP // 2
    ordinal = F.when(F.col("_keep"), F.shiftright(hash_ordinal(id_col, seed), 1)).otherwise(
        half + F.shiftright(hash_ordinal(id_col, topup_seed), 1))
    second = F.when(F.col("_keep"), hash_key(id_col, seed)).otherwise(hash_key(id_col, topup_seed))
    marked = mark_first(base, n, ordinal, [second, id_col], "_first", top=HASH_TOP)
    out = marked.where(F.col("_keep") | F.col("_first")).drop("_keep", "_first")
    # the shuffle needs positions of the sample's ids only
    pos = global_position(out.select(F.col(id_col).alias("_id"), hash_key(id_col, seed).alias("_sk")), ["_sk", "_id"])
    return out.join(pos.select("_id", "pos"), F.col(id_col) == F.col("_id")).drop("_id")
