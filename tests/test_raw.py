import gzip
import json

import pytest

from basketline import schemas
from basketline.operators import features
from basketline.sources import raw
from tests.helpers import rows


def write(folder, name, lines):
    with gzip.open(folder / name, "wt", encoding="utf-8") as f:
        f.write("\n".join(line if isinstance(line, str) else json.dumps(line) for line in lines))
    return str(folder)


def reviews(spark, tmp_path, *records, lenient=True, **options):
    path = write(tmp_path, "Books.jsonl.gz", [{"user_id": "u"} | r if isinstance(r, dict) else r for r in records])
    return raw.clean_reviews(raw.read_review_lines(spark, path, lenient), **options)


def test_helpful_votes(spark, tmp_path):
    values = ["7", "3.5", 3.7, None, 99, "x", True, -2]
    df = reviews(spark, tmp_path, *[{"asin": str(i), "helpful_votes": v} for i, v in enumerate(values)])
    found = [h for _, h in sorted(rows(df, "product_id", "helpful_votes"))]
    assert found == [7, 0, 3, 0, 99, 0, 1, -2]


def test_helpful_votes_fall_back_only_when_the_key_is_absent(spark, tmp_path):
    df = reviews(
        spark, tmp_path,
        {"asin": "1", "helpful_vote": 4},
        {"asin": "2", "helpful_votes": None, "helpful_vote": 4},
        {"asin": "3", "helpful_votes": 0, "helpful_vote": 4},
        {"asin": "4"},
    )
    assert sorted(rows(df, "product_id", "helpful_votes")) == [("1", 4), ("2", 0), ("3", 0), ("4", 0)]
    one_name = reviews(spark, tmp_path, {"helpful_vote": 4}, helpful_fields=("helpful_votes",))
    assert rows(one_name, "helpful_votes") == [(0,)]


def test_product_and_time_skip_falsy_values(spark, tmp_path):
    df = reviews(
        spark, tmp_path,
        {"asin": "", "product_id": "q", "timestamp": 0, "unixReviewTime": 5},
        {"asin": None, "item_id": 0, "id": 12, "timestamp": "17"},
        {"asin": 0, "unix_time": 9.9},
        {"asin": "z", "timestamp": "1.5"},
    )
    assert rows(df, "product_id", "unixReviewTime") == [("q", 5), ("12", 17), (None, 9), ("z", None)]


def test_time_unit(spark, tmp_path):
    df = reviews(spark, tmp_path, {"timestamp": 1588687728923}, time_unit="ms")
    assert rows(df, "unixReviewTime") == [(1588687728,)]


def test_ratings(spark, tmp_path):
    values = [5, "4.5", "bad", None, "NaN", 1e1]
    df = reviews(spark, tmp_path, *[{"rating": v} for v in values])
    assert rows(df, "rating") == [(5.0,), (4.5,), (None,), (None,), (None,), (10.0,)]


def test_verified(spark, tmp_path):
    values = [True, False, 1, 0, "", "false", None, [], [0], {}]
    df = reviews(spark, tmp_path, *[{"verified_purchase": v} for v in values])
    assert [v for (v,) in rows(df, "verified_purchase")] == [
        True, False, True, False, False, True, False, False, True, False,
    ]
    either = reviews(spark, tmp_path, {"verified_purchase": False, "verified": True}, {"verified": "x"})
    assert rows(either, "verified_purchase") == [(True,), (True,)]


def test_users(spark, tmp_path):
    df = reviews(spark, tmp_path, {"user_id": None}, {"user_id": ""}, {"user_id": 5}, "{}")
    assert rows(df, "user_id", "category") == [("", "Books"), ("5", "Books")]


BROKEN = ['{"user_id": "a", "asin": "1"}', "", "   ", '{"user_id": "b", "asin"', '{"user_id": "c"}']


def test_lenient_drops_and_counts_malformed_lines(spark, tmp_path):
    path = write(tmp_path, "Books.jsonl.gz", BROKEN)
    lines = raw.read_review_lines(spark, path)
    assert rows(raw.clean_reviews(lines), "user_id") == [("a",), ("c",)]
    assert rows(raw.count_rejects(lines, "user_id")) == [("Books", 3, 1, 1, 0, 2)]


def test_strict_fails_on_a_malformed_line(spark, tmp_path):
    path = write(tmp_path, "Books.jsonl.gz", BROKEN)
    with pytest.raises(Exception, match="(?i)malformed|FAILFAST"):
        raw.clean_reviews(raw.read_review_lines(spark, path, lenient=False)).collect()


def test_strict_skips_blank_lines(spark, tmp_path):
    path = write(tmp_path, "Books.jsonl.gz", BROKEN[:3])
    strict = raw.read_review_lines(spark, path, lenient=False)
    assert rows(raw.clean_reviews(strict), "user_id") == [("a",)]


def test_category_from_file_name(spark, tmp_path):
    write(tmp_path, "Arts & Crafts+More.jsonl.gz", ['{"user_id": "u"}'])
    write(tmp_path, "meta_Books.jsonl.gz", ['{"user_id": "v"}'])
    df = raw.clean_reviews(raw.read_review_lines(spark, str(tmp_path)))
    assert set(rows(df, "user_id", "category")) == {("u", "Arts & Crafts+More"), ("v", "Books")}


def items(spark, tmp_path, *records):
    path = write(tmp_path, "meta_Books.jsonl.gz", list(records))
    return raw.clean_items(raw.read_item_lines(spark, path))


def test_item_categories(spark, tmp_path):
    values = [
        [["x", None], "y", "x"], ["a", None, "a"], [], "solo", [[], ["p"]], 7, None,
    ]
    df = items(spark, tmp_path, *[{"asin": str(i), "categories": v} for i, v in enumerate(values)])
    assert [c for _, c in sorted(rows(df, "product_id", "item_categories"))] == [
        ["x", "y"], ["a", "None"], None, ["solo"], ["p"], ["7"], None,
    ]
    other = items(spark, tmp_path, {"asin": "1", "categories": [], "category": "backup"})
    assert rows(other, "item_categories") == [(["backup"],)]


def test_item_rating_price_and_number(spark, tmp_path):
    df = items(
        spark, tmp_path,
        {"asin": "1", "avg_rating": "n/a", "average_rating": "4.5", "rating": 1, "price": "$5"},
        {"asin": "2", "rating": 3, "price": "12.5", "rating_number": "8"},
        {"asin": "3", "avg_rating": 2, "rating": 3, "price": "None", "rating_number": 8.9},
        {"asin": "4", "price": None, "rating_number": "many"},
    )
    assert rows(df, "item_avg_rating", "price", "rating_number") == [
        (4.5, None, None), (3.0, 12.5, 8), (2.0, None, 8), (None, None, None),
    ]


def test_last_item_line_wins(spark, tmp_path):
    df = items(
        spark, tmp_path,
        {"parent_asin": "1", "rating": 1}, {"asin": "2"}, {"parent_asin": "", "asin": "1", "rating": 2},
        {"parent_asin": None, "asin": ""}, "{broken", {"parent_asin": "1", "rating": 3, "categories": "z"},
    )
    latest = features.latest_items(df)
    assert sorted(rows(latest, "product_id", "item_avg_rating", "item_categories")) == [
        ("1", 3.0, ["z"]), ("2", None, None),
    ]


def test_no_item_file_gives_an_empty_typed_table(spark):
    empty = raw.clean_items(raw.read_item_lines(spark, None))
    assert empty.count() == 0
    assert {f.name for f in schemas.ITEMS} <= set(empty.columns)
    assert dict(features.latest_items(empty).dtypes)["item_categories"] == "array<string>"


def test_scan_reads_only_the_needed_fields(spark, tmp_path):
    path = write(tmp_path, "Books.jsonl.gz", ['{"user_id": "u"}'])
    counted = raw.clean_reviews(raw.read_review_lines(spark, path, lenient=False)).groupBy("user_id").count()
    plan = counted._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<user_id:string>" in plan
