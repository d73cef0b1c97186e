"""Tunable settings and fixed values used across the package."""

# ---- Fixed values: thresholds and caps that define the results -----------------------------------
# Columns a profile is limited to; None: all of them.
MAX_COLS: int | None = None
MAX_CATEGORIES = 10
MAX_CHARTS = 20
KPI_TOP_K = 10
MIN_DATE, MAX_DATE = 1900, 2100
MIN_CORRELATION = 0.5
STAT_MAX_COLS = 40
ML_MIN_ROWS = 50
ML_CV_FOLDS = 5
ML_MAX_FEATURES = 50
ML_MAX_CLASSES = 12
ML_MAX_CAT_CARDINALITY = 30
ML_PERMUTATION_REPEATS = 5
ML_LEAKAGE_CORR = 0.999
ML_TOP_FEATURES = 15
ML_MAX_SEGMENTS = 6
ML_SCATTER_MAX_POINTS = 1500
FORECAST_HORIZON = 12
FORECAST_MIN_POINTS = 24
MAX_UPLOAD_COLS = 512
MAX_UPLOAD_ROWS = 1_048_576
NULL_ROW_FRACTION = 1.0
NUMERIC_COERCE_FRACTION = 0.95
CRITIC_ID_UNIQUE_RATIO = 0.99
CRITIC_TOTAL_TOLERANCE = 0.01
CRITIC_SHARE_SUM_TOLERANCE = 0.02
CRITIC_STD_MEAN_RATIO = 3.0
CRITIC_MIN_ROWS = 12
AUTO_ACCEPT_CONFIDENCE = 0.70
CONFIDENCE_FLOOR = 0.50
INTERACT_MAX_FILTERS = 12
INTERACT_MEMO_ENTRIES = 256
DENSITY_THRESHOLD = 10_000
SENTINELS = (
    "na", "n/a", "nan", "null", "none", "nil", "-", "--", "?", "#n/a", "#na", "#value!", "#ref!",
    "unknown", "not available",
)

# ---- Engine settings (ours): bounds that decide between one-task and distributed plans -----------
# Largest number of rows an ordered window may hold in one task; beyond it data is cut into value ranges.
TASK_ROWS = 2_000_000
# Largest row count of a table we broadcast by hint.
BROADCAST_ROWS = 100_000
# Accuracy of the quantile sketch used to choose cut points (never to answer a query).
SKETCH_ACCURACY = 10_000
