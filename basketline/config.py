"""Default thresholds and sizes, one place for all operators.

Every operator takes these as keyword arguments; nothing reads them behind the
caller's back.
"""

# Results depend on them, so they equal the published settings.
USER_BUCKETS = 256
IMPORTANCE_PERCENTILE = 0.95
MIN_TOTAL_PURCHASES = 3
MIN_DISTINCT_CATEGORIES = 3
N_LATEST_CATEGORIES = 5
MIN_PREFIX_LENGTH = 3
TRAIN_SPLIT = 0.8
VAL_SPLIT = 0.1
RANDOM_SEED = 42
ENTROPY_EPSILON = 1e-9
HELPFUL_CLIP_RAW = 10
HELPFUL_CLIP_TOP_USERS = 50
PURCHASES_CLIP = 50
MAX_RECORDS_PER_FILE = 500_000

# Rows that a model is fitted to at most. Validation and test rows are never cut.
FIT_ROWS = {
    "logistic_regression": 1_000_000,
    "gradient_boosting": 600_000,
    "tree_models": 300_000,
}
TUNING_TRIALS = 10
TUNING_ROWS = 200_000
ENSEMBLE_SIZE = 2
#: Rounds without a gain on held-out rows after which a search trial ends.
TUNING_PATIENCE = 20

# Scale guards of this library.
#: A user with more rows than this is not handled in one window partition.
HOT_KEY_ROWS = 1_000_000
#: Rows in one piece of a hot user's history.
HOT_CHUNK_ROWS = 250_000
#: Keys that may be shipped to every executor as a broadcast table.
MAX_BROADCAST_KEYS = 100_000
#: Rows that exact order statistics may hold in one aggregation buffer.
EXACT_RANK_ROWS = 200_000
#: Training rows in one partition; the same on every cluster, as bagging depends on it.
FIT_PARTITION_ROWS = 10_000
#: Partitions of training rows at most; they grow beyond that.
FIT_PARTITIONS = 24
#: Categories that may become columns of a wide table.
MAX_CATEGORY_COLUMNS = 2_000
