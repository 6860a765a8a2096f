"""Small helpers shared by the tests."""

from __future__ import annotations

import math
import uuid


def rows(df, *columns):
    picked = df.select(*columns) if columns else df
    return [tuple(r) for r in picked.collect()]


def as_set(df, *columns):
    return set(rows(df, *columns))


def same(a, b, tol=1e-9):
    if a is None or b is None:
        return a is None and b is None
    if isinstance(a, float) or isinstance(b, float):
        return math.isclose(a, b, rel_tol=tol, abs_tol=tol)
    return a == b


def physical_plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def brute_force_samples(events, names, n_latest=5, min_prefix=3, step=1):
    """Every sample by the definition: look at the whole prefix again each time.

    ``events`` are (user, time, tie, category, rating, helpful, item_avg, verified).
    """
    index = {"Unknown": 0}
    for name in names:
        index.setdefault(name, len(index))
    by_user = {}
    for event in events:
        if event[0] is not None and event[1] is not None:
            by_user.setdefault(event[0], []).append(event)
    out = {}
    for user, history in by_user.items():
        history = sorted(history, key=lambda e: (e[1], e[2]))
        for length in range(min_prefix, len(history)):
            if (length - min_prefix) % step:
                continue
            prefix, following = history[:length], history[length]
            cats = [index.get(e[3], 0) for e in prefix]
            ratings = [e[4] for e in prefix if e[4] is not None]
            items = [e[6] for e in prefix if e[6] is not None]
            last = prefix[-1]
            counts = [cats.count(i) for i in range(len(index))]
            sample = {
                "prefix_timespan": last[1] - prefix[0][1],
                "prefix_avg_rating": sum(ratings) / len(ratings) if ratings else None,
                "prefix_avg_helpful": sum(e[5] or 0 for e in prefix) / length,
                "prefix_avg_item_avg_rating": sum(items) / len(items) if items else None,
                "last_category_idx": cats[-1],
                "last_rating": last[4],
                "last_helpful_votes": float(last[5] or 0),
                "last_item_avg_rating": last[6],
                "last_verified": int(bool(last[7])),
                "prefix_most_freq_category_idx": counts.index(max(counts)),
                "target_category_idx": index.get(following[3], 0),
                "target_category": following[3],
            }
            for k in range(n_latest):
                sample[f"last_{k + 1}_category_idx"] = cats[-1 - k] if k < length else 0
            for name, i in index.items():
                sample[f"prefix_cat_count_{name}"] = counts[i]
            out[(user, length)] = sample
    return out


def jobs_of(spark, action) -> int:
    """Spark jobs that ``action`` runs."""
    context, group = spark.sparkContext, f"jobs-{uuid.uuid4().hex}"
    context.setJobGroup(group, "counted")
    try:
        action()
        return len(context.statusTracker().getJobIdsForGroup(group))
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
