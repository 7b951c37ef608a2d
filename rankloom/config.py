"""Dataset configuration record and the fixed constants the scorers use."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

# ── Fixed values (must equal the behaviour being rebuilt) ────────────────────
# Required rating columns and the optional behaviour signals with their weights.
REQUIRED_RATING_COLS = ["user_id", "item_id", "rating", "timestamp"]
REQUIRED_ITEM_COLS = ["item_id"]
BEHAVIOR_FLAG_WEIGHTS = {
    "clicked": 0.3,
    "liked": 0.5,
    "wishlist": 0.5,
    "add_to_cart": 0.7,
    "ordered": 1.0,
}
VIEW_TIME_COL = "view_time_sec"
VIEW_TIME_SATURATION = 300.0
VIEW_TIME_WEIGHT = 0.5
BEHAVIOR_COLS = list(BEHAVIOR_FLAG_WEIGHTS) + [VIEW_TIME_COL]
# Largest extra engagement: sum of flag weights plus the view-time weight.
MAX_EXTRA_ENGAGEMENT = sum(BEHAVIOR_FLAG_WEIGHTS.values()) + VIEW_TIME_WEIGHT

# Scorer parameters.
CF_FACTORS = 50
CF_BIAS_REG = 25.0
CF_POP_BETA = 0.5
CBF_LIKE_THRESHOLD = 3.5
CBF_POP_WEIGHT = 0.05
RELEVANCE_THRESHOLD = 3.5
EXPLAIN_LIKE_THRESHOLD = 4.0
CONTEXT_MIN_SUPPORT = 10
NCF_NEG_RATIO = 4
DEFAULT_WEIGHTS = (0.30, 0.30, 0.40)  # (cf, cbf, ncf)
WEIGHT_STEP = 0.1
CTX_ALPHA_GRID = [0.0, 0.05, 0.15]
DEFAULT_CTX_ALPHA = 0.15
N_CANDIDATES = 200
EVAL_K = [5, 10, 20]
EVAL_LIST_LEN = 20
TEST_RATIO = 0.2
VAL_RATIO = 0.1
DEFAULT_HOUR, DEFAULT_DOW, DEFAULT_MON = 12, 2, 5
N_VOCAB_FEATURES = 12
TITLE_MAX_CHARS = 120
CORE_MIN = 3
CORE_ROUNDS = 3
EMA_MAX_ALPHA = 0.6
EMA_BASE = 0.2
# Missing-value tokens the CSV reader maps to null.
CSV_NULL_TOKENS = ["", "NA", "N/A", "NaN", "nan", "null", "NULL", "None", "#N/A", "<NA>", "-NaN", "-nan",
                   "n/a", "#NA", "#N/A N/A", "1.#IND", "1.#QNAN", "-1.#IND", "-1.#QNAN"]


@dataclass(frozen=True)
class DatasetConfig:
    """Dataset description (job parameter). Two fields are required."""

    dataset_name: str
    feature_cols: list[str]
    item_label: str = "item"
    feature_label: str = "Category"
    rating_threshold: float = 3.5
    item_name_col: str = "name"

    def __post_init__(self):
        if not isinstance(self.dataset_name, str) or not self.dataset_name:
            raise ValueError("dataset_name is required")
        if not isinstance(self.feature_cols, (list, tuple)) or not all(
                isinstance(c, str) for c in self.feature_cols):
            raise ValueError("feature_cols must be a list of strings")
        object.__setattr__(self, "feature_cols", list(self.feature_cols))
        object.__setattr__(self, "rating_threshold", float(self.rating_threshold))

    @classmethod
    def from_dict(cls, d: dict) -> "DatasetConfig":
        missing = [k for k in ("dataset_name", "feature_cols") if k not in d]
        if missing:
            raise ValueError(f"config is missing required field(s): {missing}")
        known = {k: d[k] for k in cls.__dataclass_fields__ if k in d}
        return cls(**known)

    @classmethod
    def from_json(cls, text: str) -> "DatasetConfig":
        return cls.from_dict(json.loads(text))

    def to_meta_dict(self) -> dict:
        meta = asdict(self)
        meta["genre_cols"] = list(self.feature_cols)  # legacy alias kept in meta
        return meta


# Fixture R configuration: the 22 categories derived from `part` (see FIXTURES.md).
RETAIL_TYPES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
RETAIL_WORDS = ["blue", "cold", "hot", "large", "new", "old", "red", "small",
                "anvil", "bolt", "gear", "gizmo", "plate", "ring", "rod", "widget"]
RETAIL_CONFIG = DatasetConfig(
    dataset_name="retail-parts",
    feature_cols=[f"type_{t}" for t in RETAIL_TYPES] + [f"w_{w}" for w in RETAIL_WORDS],
    item_label="part",
    feature_label="Category",
    rating_threshold=4.0,
    item_name_col="product_name",
)


@dataclass
class RunParams:
    """Knobs shared by the training and serving jobs."""

    n: int = 10
    n_candidates: int = N_CANDIDATES
    hour: int = DEFAULT_HOUR
    dow: int = DEFAULT_DOW
    mon: int = DEFAULT_MON
    weights: tuple = field(default_factory=lambda: DEFAULT_WEIGHTS)
    ctx_alpha: float = DEFAULT_CTX_ALPHA
