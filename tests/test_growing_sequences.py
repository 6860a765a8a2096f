import json

import pytest

from basketline.streaming.growing_sequences import SequenceStore, extend_from_files
from tests.helpers import brute_force_samples, rows, same
from tests.test_sequences import NAMES, SCHEMA, history

OPTIONS = {"tie_break": ["tie"]}


def batches_of(events, *cuts):
    """The events in batches by time; those without one go to the first."""
    bounds = [-1, *cuts, 10**9]
    return [
        [e for e in events if low < (0 if e[1] is None else e[1]) <= high]
        for low, high in zip(bounds, bounds[1:])
    ]


def check_store(store, events, n_latest=5, min_prefix=3, step=1):
    expected = brute_force_samples(events, NAMES, n_latest, min_prefix, step)
    samples = store.samples().collect()
    assert len(samples) == len(expected)
    for row in samples:
        for name, value in expected[(row["user_id"], row["prefix_length"])].items():
            assert same(row[name], value), (row["user_id"], row["prefix_length"], name)


def test_batches_give_the_samples_of_all_reviews(spark, tmp_path):
    """An empty batch, hot users cut into chunks, repeats of committed batches."""
    events = history(11, users=6, longest=25, one_hot=True)
    store = SequenceStore(spark, str(tmp_path / "s"), NAMES, hot_user_rows=60, chunk_rows=37, **OPTIONS)
    parts = batches_of(events, 12, 12, 13, 30)
    assert parts[1] == []
    for n, part in enumerate(parts):
        assert store.append(spark.createDataFrame(part, SCHEMA), n)
    assert not store.append(spark.createDataFrame(parts[4], SCHEMA), 4)
    assert not store.append(spark.createDataFrame(events, SCHEMA), 1)
    check_store(store, events)
    assert store.late().count() == 0 and store.batches() == [0, 1, 2, 3, 4]
    assert not (tmp_path / "s" / "batch=2" / "users").exists()
    assert (tmp_path / "s" / "batch=3" / "users").exists()


def test_one_latest_and_a_stride(spark, tmp_path):
    events = history(12, users=5, longest=20)
    options = {"n_latest": 1, "min_prefix": 1, "every_k_prefix": 3}
    store = SequenceStore(spark, str(tmp_path / "s"), NAMES, **options, **OPTIONS)
    for n, part in enumerate(batches_of(events, 20)):
        store.append(spark.createDataFrame(part, SCHEMA), n)
    check_store(store, events, 1, 1, 3)


def test_a_batch_lost_before_its_commit(spark, tmp_path, monkeypatch):
    """Nothing of it is read, and taking it again gives the right samples."""
    events = history(13, users=5, longest=20)
    first, second = batches_of(events, 25)
    store = SequenceStore(spark, str(tmp_path / "s"), NAMES, **OPTIONS)
    store.append(spark.createDataFrame(first, SCHEMA), 0)

    def lost(batch):
        raise RuntimeError("lost")

    with monkeypatch.context() as patch:
        patch.setattr(store, "_commit", lost)
        with pytest.raises(RuntimeError):
            store.append(spark.createDataFrame(second[:9], SCHEMA), 1)
    check_store(store, first)
    assert store.append(spark.createDataFrame(second, SCHEMA), 1)
    check_store(store, events)


def test_late_reviews_are_kept_apart(spark, tmp_path):
    def review(user, time):
        return (user, time, time, "a", 4.0, 1, None, True)

    first = [review("u", t) for t in (1, 2, 5, 6)] + [review("v", 9)]
    second = [review("u", 4), review("u", 7), review("v", 8), review("w", 3), (None, 1, 1, "a", None, None, None, None)]
    store = SequenceStore(spark, str(tmp_path / "s"), NAMES, **OPTIONS)
    with pytest.raises(ValueError):
        store.samples()
    store.append(spark.createDataFrame(first, SCHEMA), 0)
    store.append(spark.createDataFrame(second, SCHEMA), 1)
    assert sorted(rows(store.late(), "user_id", "unixReviewTime")) == [("u", 4), ("v", 8)]
    check_store(store, first + [review("u", 7)])
    other = SequenceStore(spark, str(tmp_path / "s"), ["a"], **OPTIONS)
    with pytest.raises(ValueError):
        other.append(spark.createDataFrame(second, SCHEMA), 2)


def test_files_in_a_stream(spark, tmp_path):
    events = [e for e in history(14, users=4, longest=12) if e[1] is not None]
    names = [part.split()[0] for part in SCHEMA.split(", ")]
    source = tmp_path / "in"
    source.mkdir()
    store = SequenceStore(spark, str(tmp_path / "s"), NAMES, **OPTIONS)
    schema = spark.createDataFrame([], SCHEMA).schema
    for n, part in enumerate(batches_of(events, 25)):
        lines = [json.dumps(dict(zip(names, e))) for e in part]
        (source / f"{n}.json").write_text("\n".join(lines))
        extend_from_files(store, str(source), schema, str(tmp_path / "c")).awaitTermination()
    assert len(store.batches()) == 2
    check_store(store, events)
