"""One training sample per (user, prefix of the user's purchase history).

All running values are window functions over a user's rows in time order, and all
windows share one shuffle by user. A user too large for one task is cut into
ordered chunks: the same windows run per chunk, and each chunk is given what came
before it (sums, category counts, last categories) from a small per-chunk table.
Both ways give the same rows. ``extend_samples`` goes on from a stored summary of all
earlier histories in the same way: what was seen before is one more chunk.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketline.config import (
    HOT_CHUNK_ROWS,
    HOT_KEY_ROWS,
    MIN_PREFIX_LENGTH,
    N_LATEST_CATEGORIES,
)
from basketline.functions.entropy import x_log_x
from basketline.operators.skew import cut_in_order, hot_keys, known_hot_keys, split_hot
from basketline.sources.categories import (
    as_columns,
    category_index,
    with_category_index,
    with_category_name,
)
from basketline.sources.tables import with_review_defaults
from basketline.staging import stage

_VALUES = ["category_idx", "rating", "helpful_votes", "item_avg_rating", "verified_purchase"]
_BEFORE = Window.unboundedPreceding


def purchase_events(
    reviews: DataFrame, categories: list[str], tie_break: list[str] | None = None
) -> DataFrame:
    """Reviews with a time, their category index and missing columns defaulted.

    ``tie_break`` names columns that order rows of equal time; without it, the
    product and then all values do, which leaves only identical rows unordered.
    """
    timed = with_review_defaults(_timed(reviews)).withColumn(
        "unixReviewTime", F.col("unixReviewTime").cast("long")
    )
    named = "category" in timed.columns
    timed = (with_category_index if named else with_category_name)(timed, categories)
    ties = _tie_columns(timed, tie_break)
    columns = dict.fromkeys(["user_id", "unixReviewTime", "category", *ties, *_VALUES])
    return timed.select(*columns)


def _timed(reviews: DataFrame) -> DataFrame:
    return reviews.where(F.col("unixReviewTime").isNotNull() & F.col("user_id").isNotNull())


def _tie_columns(df: DataFrame, tie_break: list[str] | None) -> list[str]:
    if tie_break is not None:
        return list(tie_break)
    return (["product_id"] if "product_id" in df.columns else []) + _VALUES


def sequence_samples(
    reviews: DataFrame,
    categories: list[str],
    static: DataFrame | None = None,
    *,
    n_latest: int = N_LATEST_CATEGORIES,
    min_prefix: int = MIN_PREFIX_LENGTH,
    every_k_prefix: int = 1,
    category_counts: bool = True,
    category_spread: bool = False,
    tie_break: list[str] | None = None,
    hot_user_rows: int = HOT_KEY_ROWS,
    chunk_rows: int = HOT_CHUNK_ROWS,
    sizes: DataFrame | None = None,
    as_of: int | None = None,
    by_user: bool = False,
) -> DataFrame:
    """Samples for every prefix of at least ``min_prefix`` purchases with a next one.

    ``static`` holds at most one row per user; users without one keep their samples
    with null features. ``sizes`` is a stored table with the ``total_purchases`` of each
    ``user_id``; without it, the reviews are read once more to find very active users.
    ``category_spread`` adds the largest category count of the prefix and the sum of
    ``n ln n`` over its category counts: two columns for any number of categories.
    ``as_of`` keeps only prefixes whose next purchase is later than that time.
    ``by_user`` says that the reviews are a table in buckets by user (``write_bucketed``), so
    that only users cut into chunks are shuffled; so is ``static`` if it has as many buckets.
    """
    events = purchase_events(reviews, categories, tie_break)
    order = ["unixReviewTime", *_tie_columns(events, tie_break)]
    index = _columns_of(categories, category_counts)
    if sizes is None:
        hot = hot_keys(_timed(reviews).select("user_id"), "user_id", hot_user_rows)
    else:
        hot = known_hot_keys(sizes, "user_id", "total_purchases", hot_user_rows)
    ordinary, heavy = split_hot(events, "user_id", hot)

    def finish(prefixes: DataFrame, features: DataFrame | None) -> DataFrame:
        kept = _emitted(prefixes, min_prefix, every_k_prefix)
        if as_of is not None:
            kept = kept.where(F.col("_next.time") > as_of)
        return _sample_columns(kept, features, index, n_latest, category_spread)

    samples = finish(_prefixes(ordinary, order, index, n_latest, by_user), static)
    if heavy is None:
        return samples
    few = None if static is None else static.join(hot, "user_id", "left_semi")
    chunked = cut_in_order(heavy, "user_id", order, chunk_rows).drop("_row")
    return samples.unionByName(finish(_chunked_prefixes(chunked, order, index, n_latest), few))


def _columns_of(categories: list[str], category_counts: bool) -> dict[str, int]:
    return category_index(as_columns(categories)) if category_counts else {}


def _emitted(prefixes: DataFrame, min_prefix: int, every_k_prefix: int) -> DataFrame:
    """Prefixes that are long enough, have a next purchase and fall on the stride."""
    kept = prefixes.where((F.col("prefix_length") >= min_prefix) & F.col("_next").isNotNull())
    if every_k_prefix > 1:
        step = F.pmod(F.col("prefix_length") - min_prefix, F.lit(every_k_prefix))
        kept = kept.where(step == 0)
    return kept


# Samples of new reviews only ---------------------------------------------------


@dataclass(frozen=True)
class Carry:
    """All that later samples need of the reviews so far.

    ``users`` has the last prefix of each user, with its running values, waiting for the
    next purchase; ``counts`` the purchases per user and category.
    """

    users: DataFrame
    counts: DataFrame


@dataclass(frozen=True)
class Extension:
    """Samples that new reviews bring, the carry after them, and reviews that came too late."""

    samples: DataFrame
    carry: Carry
    late: DataFrame


def extend_samples(
    reviews: DataFrame,
    categories: list[str],
    carry: Carry | None = None,
    *,
    n_latest: int = N_LATEST_CATEGORIES,
    min_prefix: int = MIN_PREFIX_LENGTH,
    every_k_prefix: int = 1,
    category_counts: bool = True,
    category_spread: bool = False,
    tie_break: list[str] | None = None,
    hot_user_rows: int = HOT_KEY_ROWS,
    chunk_rows: int = HOT_CHUNK_ROWS,
) -> Extension:
    """The samples whose target is among ``reviews``, without reading earlier reviews again.

    The samples of all batches together are those of ``sequence_samples`` over all reviews,
    if each user's reviews come in order. A review that belongs before one already taken
    would change samples that are out: it is left in ``late``, in the form of
    ``purchase_events``, and enters nothing else. Rows without user or time are dropped.
    Keep the settings and ``categories`` the same from batch to batch.
    """
    events = purchase_events(reviews, categories, tie_break)
    order = ["unixReviewTime", *_tie_columns(events, tie_break)]
    index = _columns_of(categories, category_counts)
    batch = stage(events, "new-reviews")
    late = batch.limit(0)
    if carry is not None:
        last = carry.users.select("user_id", F.struct(*order).alias("_last"))
        placed = batch.join(last, "user_id", "left").withColumn(
            "_late", F.coalesce(F.struct(*order) < F.col("_last"), F.lit(False))
        )
        checked = stage(placed.drop("_last"), "checked-reviews")
        late = checked.where("_late").drop("_late")
        batch = checked.where(~F.col("_late")).drop("_late")

    hot = hot_keys(batch.select("user_id"), "user_id", hot_user_rows)
    ordinary, heavy = split_hot(batch, "user_id", hot)
    chunked = ordinary.withColumn("chunk", F.lit(0))
    if heavy is not None:
        chunked = chunked.unionByName(cut_in_order(heavy, "user_id", order, chunk_rows).drop("_row"))

    # One small row per user of the batch: its first new purchase.
    first = chunked.groupBy("user_id").agg(F.min_by(_following(), F.struct(*order)).alias("_next"))
    earlier = waiting = None
    if carry is not None:
        waiting = carry.users.drop("_next").join(first, "user_id")
        known = carry.counts.join(first.select("user_id"), "user_id", "left_semi")
        earlier = Carry(waiting, known)
    state = ["user_id", *[c for c in chunked.columns if c not in ("user_id", "chunk")]]
    state += [*_additive(index), "_first_time", "_favourite", "_spread", "_next"]
    state += [*[f"_back_{k}" for k in range(1, n_latest)], "prefix_length"]
    prefixes = stage(
        _chunked_prefixes(chunked, order, index, n_latest, earlier).select(*state), "new-prefixes"
    )
    users = prefixes.where(F.col("_next").isNull())
    counts = batch.groupBy("user_id", "category_idx").agg(F.count(F.lit(1)).alias("_n"))
    if carry is not None:
        users = users.unionByName(carry.users.join(first, "user_id", "left_anti"))
        prefixes = prefixes.unionByName(waiting)
        both = carry.counts.unionByName(counts)
        counts = both.groupBy("user_id", "category_idx").agg(F.sum("_n").alias("_n"))
    emitted = _emitted(prefixes, min_prefix, every_k_prefix)
    samples = _sample_columns(emitted, None, index, n_latest, category_spread)
    return Extension(samples, Carry(users, counts), late)


# Running values -------------------------------------------------------------


def _additive(index: dict[str, int]) -> dict[str, Column]:
    """Row values whose running sums describe a prefix."""
    rating, item = F.col("rating"), F.col("item_avg_rating")
    idx = F.col("category_idx")
    return {
        "_rows": F.lit(1).cast("long"),
        "_rating_sum": F.coalesce(rating.cast("double"), F.lit(0.0)),
        "_rating_n": rating.isNotNull().cast("long"),
        "_helpful_sum": F.coalesce(F.col("helpful_votes").cast("double"), F.lit(0.0)),
        "_item_sum": F.coalesce(item.cast("double"), F.lit(0.0)),
        "_item_n": item.isNotNull().cast("long"),
        **{f"_count_{i}": (idx == i).cast("long") for i in index.values()},
    }


def _following() -> Column:
    """What a sample needs of the purchase after its prefix."""
    return F.struct("category_idx", "category", F.col("unixReviewTime").alias("time"))


def _rank_of(count: Column) -> Column:
    """Orders categories by count, the smaller index first among equals."""
    return F.struct(count.alias("count"), (-F.col("category_idx")).alias("neg_idx"))


def _growth(before: Column, after: Column) -> Column:
    """What a category adds to the sum of ``n ln n`` as its count grows."""
    return x_log_x(after) - x_log_x(before)


def _running(df: DataFrame, keys: list[str], order: list[str], index, n_latest: int) -> DataFrame:
    """Running sums, first time, neighbours; ``_in_category`` must be there already."""
    rows = Window.partitionBy(*keys).orderBy(*order)
    run = rows.rowsBetween(_BEFORE, Window.currentRow)
    return df.select(
        "*",
        *[F.sum(value).over(run).alias(name) for name, value in _additive(index).items()],
        F.min("unixReviewTime").over(run).alias("_first_time"),
        F.max(_rank_of(F.col("_in_category"))).over(run).alias("_favourite"),
        F.sum(_growth(F.col("_in_category") - 1, F.col("_in_category"))).over(run).alias("_spread"),
        F.lead(_following()).over(rows).alias("_next"),
        *[F.lag("category_idx", k).over(rows).alias(f"_back_{k}") for k in range(1, n_latest)],
    )


def _count_in_category(keys: list[str], order: list[str]) -> Column:
    """How often the row's category has occurred so far; needs no column per category."""
    rows = Window.partitionBy(*keys, "category_idx").orderBy(*order)
    return F.count(F.lit(1)).over(rows.rowsBetween(_BEFORE, Window.currentRow))


def _prefixes(
    events: DataFrame, order: list[str], index, n_latest: int, by_user: bool = False
) -> DataFrame:
    placed = events if by_user else events.repartition("user_id")
    counted = placed.withColumn("_in_category", _count_in_category(["user_id"], order))
    running = _running(counted, ["user_id"], order, index, n_latest)
    return running.withColumn("prefix_length", F.col("_rows").cast("int"))


# Users spread over several tasks ---------------------------------------------


def _chunked_prefixes(
    chunked: DataFrame, order: list[str], index, n_latest: int, carry: Carry | None = None
) -> DataFrame:
    keys = ["user_id", "chunk"]
    past_counts, past_summary = _past_categories(chunked, carry)
    past = _past_sums(chunked, order, index, n_latest, carry).join(past_summary, keys, "left")

    placed = chunked.repartition(*keys)
    counted = placed.withColumn("_in_chunk", _count_in_category(keys, order))
    counted = counted.join(past_counts, [*keys, "category_idx"], "left").withColumn(
        "_in_category", F.col("_in_chunk") + F.coalesce("_past_in_category", F.lit(0))
    )
    local = _running(counted, keys, order, index, n_latest).join(past, keys, "left")

    merged = {
        name: F.col(name) + F.coalesce(f"_past{name}", F.lit(0)) for name in _additive(index)
    }
    merged["_first_time"] = F.least("_first_time", "_past_first_time")
    merged["_favourite"] = F.greatest("_favourite", "_past_favourite")
    merged["_spread"] = F.col("_spread") + F.coalesce("_past_spread", F.lit(0.0))
    merged["_next"] = F.coalesce("_next", "_next_head")
    for k in range(1, n_latest):
        carried = F.get("_past_latest", F.lit(k) - F.col("_rows").cast("int"))
        merged[f"_back_{k}"] = F.coalesce(f"_back_{k}", F.when(F.col("_rows") <= k, carried))
    merged["prefix_length"] = merged["_rows"].cast("int")
    return local.withColumns(merged)


#: The chunk of what was seen before the first one.
_CARRIED = -1


def _past_sums(
    chunked: DataFrame, order: list[str], index, n_latest: int, carry: Carry | None
) -> DataFrame:
    """Per chunk: sums, first time and last categories of all earlier chunks, and the
    first row of the next one. One row per chunk, so its windows are small."""
    position = F.struct(*order)
    totals = chunked.groupBy("user_id", "chunk").agg(
        *[F.sum(value).alias(name) for name, value in _additive(index).items()],
        F.min("unixReviewTime").alias("_first_time"),
        F.min_by(_following(), position).alias("_head"),
    )
    chunks = Window.partitionBy("user_id").orderBy("chunk")
    earlier = chunks.rowsBetween(_BEFORE, -1)
    columns = [F.sum(name).over(earlier).alias(f"_past{name}") for name in _additive(index)]
    columns.append(F.min("_first_time").over(earlier).alias("_past_first_time"))
    columns.append(F.lead("_head").over(chunks).alias("_next_head"))
    if n_latest > 1:
        totals = totals.join(_last_categories(chunked, order, n_latest), ["user_id", "chunk"])
    if carry is not None:
        backwards = [F.col("category_idx"), *[F.col(f"_back_{k}") for k in range(1, n_latest - 1)]]
        before = carry.users.withColumn("chunk", F.lit(_CARRIED)).withColumn(
            "_latest", F.array_compact(F.array(*backwards))
        )
        names = [c for c in totals.columns if c != "_head"]
        totals = totals.unionByName(before.select(*names), allowMissingColumns=True)
    if n_latest > 1:
        recent = F.collect_list("_latest").over(chunks.rowsBetween(-(n_latest - 1), -1))
        newest_first = F.flatten(F.reverse(recent))
        columns.append(newest_first.alias("_past_latest"))
    return totals.select("user_id", "chunk", *columns)


def _last_categories(chunked: DataFrame, order: list[str], n_latest: int) -> DataFrame:
    """The last few categories of each chunk, newest first."""
    newest = Window.partitionBy("user_id", "chunk").orderBy(*[F.desc(c) for c in order])
    last = chunked.withColumn("_age", F.row_number().over(newest)).where(
        F.col("_age") < n_latest
    )
    ordered = F.sort_array(F.collect_list(F.struct("_age", "category_idx")))
    return last.groupBy("user_id", "chunk").agg(
        ordered.getField("category_idx").alias("_latest")
    )


def _past_categories(chunked: DataFrame, carry: Carry | None) -> tuple[DataFrame, DataFrame]:
    """Counts of a chunk's categories before the chunk; favourite and spread before it."""
    per_category = chunked.groupBy("user_id", "chunk", "category_idx").agg(
        F.count(F.lit(1)).alias("_n")
    )
    if carry is not None:
        per_category = per_category.unionByName(carry.counts.withColumn("chunk", F.lit(_CARRIED)))
    by_category = Window.partitionBy("user_id", "category_idx").orderBy("chunk")
    counts = per_category.withColumn(
        "_past_in_category", F.coalesce(F.sum("_n").over(by_category.rowsBetween(_BEFORE, -1)), F.lit(0))
    )
    before, after = F.col("_past_in_category"), F.col("_past_in_category") + F.col("_n")
    own = counts.groupBy("user_id", "chunk").agg(
        F.max(_rank_of(after)).alias("_best"), F.sum(_growth(before, after)).alias("_grown")
    )
    earlier = Window.partitionBy("user_id").orderBy("chunk").rowsBetween(_BEFORE, -1)
    summary = own.select(
        "user_id",
        "chunk",
        F.max("_best").over(earlier).alias("_past_favourite"),
        F.sum("_grown").over(earlier).alias("_past_spread"),
    )
    return counts.drop("_n"), summary


# Output ------------------------------------------------------------------------


def _sample_columns(
    prefixes: DataFrame, static: DataFrame | None, index: dict[str, int], n_latest: int, spread: bool
) -> DataFrame:
    c = F.col
    spread_columns = {"prefix_cat_max": c("_favourite.count"), "prefix_cat_n_log_n": c("_spread")} if spread else {}
    if static is None:
        described, features = prefixes, []
    else:
        features = [name for name in static.columns if name != "user_id"]
        packed = static.select("user_id", F.struct(*features).alias("_static"))
        described = prefixes.join(packed, "user_id", "left")
    helpful = F.coalesce(c("helpful_votes").cast("double"), F.lit(0.0))
    latest = [c("category_idx")] + [
        F.coalesce(f"_back_{k}", F.lit(0)) for k in range(1, n_latest)
    ]
    return described.select(
        "user_id",
        *[c("_static")[name].alias(name) for name in features],
        "prefix_length",
        (c("unixReviewTime") - c("_first_time")).alias("prefix_timespan"),
        F.try_divide("_rating_sum", "_rating_n").alias("prefix_avg_rating"),
        (c("_helpful_sum") / c("_rows")).alias("prefix_avg_helpful"),
        F.try_divide("_item_sum", "_item_n").alias("prefix_avg_item_avg_rating"),
        c("category_idx").alias("last_category_idx"),
        c("rating").cast("double").alias("last_rating"),
        helpful.alias("last_helpful_votes"),
        c("item_avg_rating").cast("double").alias("last_item_avg_rating"),
        F.coalesce(c("verified_purchase").cast("int"), F.lit(0)).alias("last_verified"),
        *[value.alias(f"last_{k}_category_idx") for k, value in enumerate(latest[:n_latest], 1)],
        *[c(f"_count_{i}").alias(f"prefix_cat_count_{name}") for name, i in index.items()],
        *[value.alias(name) for name, value in spread_columns.items()],
        (-c("_favourite.neg_idx")).alias("prefix_most_freq_category_idx"),
        c("_next.category_idx").alias("target_category_idx"),
        c("_next.category").alias("target_category"),
    )
