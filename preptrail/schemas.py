"""Table schemas and fixed values shared by the whole package."""

from pyspark.sql import types as T

# --- Fixed values -----------------------------------------------------------
HORIZONS = [30, 90, 180, 360]
KNOTS = [0, 30, 90, 180, 360]
MAX_DAYS = 360
DIFFICULTIES = ["EASY", "MEDIUM", "HARD"]
SIZE_RANKS = {
    "1-10": 0,
    "11-50": 1,
    "51-200": 2,
    "201-500": 3,
    "501-1000": 4,
    "1001-5000": 5,
    "5001-10000": 6,
    "10001+": 7,
}
UNKNOWN_SIZE_RANK = 4
DEFAULT_FOUNDING_YEAR = 2000
INDUSTRY_WEIGHT = 2.0
K_MIN, K_MAX = 2, 8
KMEANS_RESTARTS = 10
KMEANS_SEED = 42
DEFAULT_COUNTS = {"easy": 3, "medium": 5, "hard": 2, "total": 10}
DEFAULT_SHARES = {"easy": 0.3, "medium": 0.5, "hard": 0.2}
DEFAULT_MAX_TOTAL = 10
PEER_CAP = 50
SNIPPET_CHARS = 1000
REGISTRY_COLUMNS = [
    "name",
    "domain",
    "year founded",
    "industry",
    "size range",
    "locality",
    "current employee estimate",
]
FEATURE_COLUMNS = ["industry_enc", "size_rank", "log_employees", "year_founded"]
VOLUME_COLUMNS = [f"d{h}" for h in HORIZONS]
# ---------------------------------------------------------------------------


TEXT, LONG, INT = T.StringType(), T.LongType(), T.IntegerType()

RAW_FEED = T.StructType(
    [
        T.StructField("company", TEXT),
        T.StructField("title", TEXT),
        T.StructField("difficulty", TEXT),
        T.StructField("link", TEXT),
        T.StructField("topics", TEXT),
        T.StructField("acceptance_rate", TEXT),
        T.StructField("frequency", TEXT),
        T.StructField("preparation_days", TEXT),
        T.StructField("body", TEXT),
    ]
)
DISTRIBUTIONS = T.StructType(
    [
        T.StructField("company", TEXT),
        T.StructField("days_until", INT),
        T.StructField("easycount", LONG),
        T.StructField("hardcount", LONG),
        T.StructField("mediumcount", LONG),
    ]
)
COMPANY_META = T.StructType(
    [
        T.StructField("company", TEXT),
        T.StructField("industry", TEXT),
        T.StructField("size_range", TEXT),
        T.StructField("employee_count", TEXT),
        T.StructField("year_founded", TEXT),
        T.StructField("locality", TEXT),
    ]
)
INTERVIEWS = T.StructType(
    [
        T.StructField("id", LONG),
        T.StructField("days_until", INT),
        T.StructField("interview_date", T.DateType()),
        T.StructField("user_id", LONG),
        T.StructField("company_id", LONG),
    ]
)
ROADMAPS = T.StructType(
    [
        T.StructField("id", LONG),
        T.StructField("interview_id", LONG),
        T.StructField("problem_id", LONG),
        T.StructField("is_completed", T.BooleanType()),
    ]
)
PREFERENCE_PAIRS = T.StructType([T.StructField("prompt", TEXT), T.StructField("chosen", TEXT), T.StructField("rejected", TEXT)])
SOLUTION_FEED = T.StructType([T.StructField("prompt", TEXT), T.StructField("completion", TEXT)])
