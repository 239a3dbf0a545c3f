"""Word lists, thresholds, labels.

Everything in this file is a value that results depend on; there is no logic here.
Words match as substrings of a normalised column name.
"""

# --- column name words -------------------------------------------------------------------

IDENTIFIER_NAMES = (
    "id", "key", "code", "number", "num", "customer_id", "order_id", "invoice_id",
    "transaction_id", "account_id", "user_id",
)
IDENTIFIER_PARTS = ("id", "code", "key")
BUSINESS_WORDS = (
    "quantity", "qty", "price", "amount", "revenue", "sales", "cost", "profit", "margin",
    "discount", "score", "rating", "value", "units", "total",
)
FORECAST_WORDS = BUSINESS_WORDS + ("demand", "volume")
FORECAST_PRIORITY = (
    "net_revenue", "profit", "quantity", "cost", "discount_pct", "rating", "unit_price",
)
DISCOUNT_WORDS = ("discount", "discount_pct", "discount_rate", "markdown")
PROFIT_WORDS = ("profit", "margin", "contribution")
DATE_WORDS = ("date", "time", "month", "year", "timestamp")
OUTCOME_WORDS = (
    "sales", "revenue", "amount", "profit", "margin", "cost", "quantity", "count", "units",
    "demand", "score", "target", "label", "y",
)
ACTIONABLE_WORDS = (
    "category", "segment", "region", "channel", "product", "department", "store", "plan",
    "status", "tier", "priority", "discount", "price", "promotion",
)
REVENUE_SIGNAL_WORDS = ("sales", "revenue", "amount", "price", "profit", "total", "value")
ID_SIGNAL_WORDS = ("id", "order", "invoice", "transaction", "customer", "user", "account")
CATEGORY_SIGNAL_WORDS = (
    "category", "segment", "type", "region", "channel", "product", "department", "group",
    "status",
)
TARGET_SIGNAL_WORDS = (
    "sales", "revenue", "amount", "profit", "total", "score", "cost", "quantity", "count",
)
CUSTOMER_TYPE_WORDS = ("customer", "client", "user", "segment", "churn")
SUPPORT_TYPE_WORDS = ("ticket", "case", "issue", "agent", "resolution", "support", "sla")
MARKETING_TYPE_WORDS = (
    "campaign", "lead", "conversion", "impression", "click", "funnel", "channel",
)

# --- thresholds --------------------------------------------------------------------------

DATE_SAMPLE_SIZE = 50
DATE_SAMPLE_MIN = 3
DATE_SAMPLE_PARSED = 0.9
DATE_SAMPLE_DISTINCT = 0.2
MAX_DIMENSION_GROUPS = 24
MAX_TREND_GROUPS = 8
MODELING_ROWS = 60
STRONG_MODELING_ROWS = 120
TARGET_ROWS = 40
STRONG_TARGET_ROWS = 80
STRONG_TIME_PERIODS = 6
MONTH_COUNT_DEPTH_DAYS = 45
STRONG_TIME_DEPTH_DAYS = 120
COMPLETENESS = 0.6
FORECAST_PARSE_RATE = 0.8
FORECAST_MIN_PERIODS = 6
FORECAST_HORIZONS = (3, 6, 9, 12)
MOVING_AVERAGE_WEIGHT = 0.65
TREND_WEIGHT = 0.35
VOLATILE_FROM = 0.35
VARIABLE_FROM = 0.15

# --- labels ------------------------------------------------------------------------------

READY, CONDITIONAL, NOT_READY = "Ready", "Conditional", "Not Ready"
GRAIN_CODES = {"Daily": "D", "Weekly": "W", "Monthly": "M"}
GRAIN_OPTIONS = ("Auto", "Daily", "Weekly", "Monthly")
FORECAST_METHOD = "Trend-based lightweight projection"
DATASET_TYPES = (
    "transactional", "time_series", "customer", "service_support", "marketing_funnel",
    "generic_tabular",
)
# points per dataset type, in the order of DATASET_TYPES
TYPE_POINTS = {
    "date": (2, 3, 0, 0, 1, 0),
    "revenue": (3, 1, 0, 0, 2, 0),
    "id": (2, 0, 2, 1, 0, 0),
    "category": (1, 0, 1, 1, 2, 0),
    "target": (2, 2, 0, 0, 1, 0),
    "customer_words": (0, 0, 4, 0, 0, 0),
    "support_words": (0, 0, 0, 5, 0, 0),
    "marketing_words": (0, 0, 0, 0, 5, 0),
    "single_date": (0, 2, 0, 0, 0, 0),
    "categories_and_revenue": (2, 0, 0, 0, 0, 0),
    "baseline": (0, 0, 0, 0, 0, 1),
}
NARRATIVE_SECTIONS = ("Executive Summary", "Key Insights", "Risks", "Recommended Actions")
NARRATIVE_CAPS = (1, 3, 2, 3)
NARRATIVE_DEFAULT_SECTION = "Key Insights"

# --- CSV ---------------------------------------------------------------------------------

MISSING_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)
