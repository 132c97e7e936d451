"""Parameters, grouped. Operators take them as keyword arguments; nothing reads them globally."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

# Names of the panel's columns, in their contractual order.
KEY_COLUMNS = ["symbol", "observation_date", "quarter_end"]
PLEDGE_FEATURES = [
    "promoter_holding_pct", "pledge_pct_promoter", "pledge_pct_equity", "pledge_chg_1q",
    "pledge_chg_2q", "pledge_accel", "consecutive_rising_q", "pledge_max_4q",
]
MARKET_FEATURES = [
    "volatility_90d", "trailing_dd_60d", "return_90d", "rel_return_90d", "log_turnover_90d",
]
EVENT_FEATURES = [
    "event_created_90d", "event_released_90d", "event_net_90d", "event_count_90d",
    "event_days_since", "event_invocations_365d",
]
LABEL_COLUMNS = ["fwd_max_drawdown", "label", "label_is_valid"]
ALL_FEATURES = PLEDGE_FEATURES + MARKET_FEATURES + EVENT_FEATURES
PANEL_COLUMNS = KEY_COLUMNS + ALL_FEATURES + ["is_stale"] + LABEL_COLUMNS

STATIC_FEATURES = PLEDGE_FEATURES[:3]
NULL_FEATURES = ["volatility_90d", "log_turnover_90d"]


@dataclass(frozen=True)
class Windows:
    """Look-back and look-ahead lengths. Bars count rows, days count calendar days."""

    volatility_bars: int = 90
    drawdown_bars: int = 60
    return_bars: int = 90
    turnover_bars: int = 90
    bars_per_year: int = 252
    horizon_bars: int = 60
    threshold: float = -0.15
    break_floor: float = -0.35
    observation_lag_days: int = 30
    event_days: int = 90
    invocation_days: int = 365
    disclosure_lag_days: int = 14
    min_pct_equity: float = 0.01
    max_fill_quarters: int = 1
    rolling_max_quarters: int = 4
    min_quarters: int = 3
    min_bars: int = 250


@dataclass(frozen=True)
class Evaluation:
    precision_at_k: int = 20
    n_quintiles: int = 5
    n_deciles: int = 10
    min_rows: int = 10
    shuffle_tolerance: float = 0.05
    n_bootstrap: int = 10_000
    confidence: float = 0.95
    seed: int = 42
    # Upper bounds of the risk bands.
    risk_bands: tuple[tuple[str, float], ...] = (
        ("LOW", 0.20), ("MEDIUM", 0.40), ("HIGH", 0.60), ("CRITICAL", 1.01),
    )


@dataclass(frozen=True)
class Population:
    """A stratum: inclusive bounds on one column, or everything when the column is None."""

    name: str
    column: str | None = None
    min_value: float | None = None
    max_value: float | None = None
    include_missing: bool = False

    def describe(self) -> str:
        if self.column is None:
            return "none"
        bounds = [f">= {self.min_value}"] if self.min_value is not None else []
        bounds += [f"<= {self.max_value}"] if self.max_value is not None else []
        text = f"{self.column} {' and '.join(bounds) or 'any'}"
        return text + (" or missing" if self.include_missing else "")


@dataclass(frozen=True)
class Experiment:
    name: str
    features: tuple[str, ...]
    population: str = "all"
    baseline: str = "exp0_null"


POPULATIONS = {
    "all": Population("all"),
    "pledged": Population("pledged", column="pledge_pct_promoter", min_value=1.0),
}

# The ten experiments of the study.
EXPERIMENTS = [
    Experiment("exp0_null", tuple(NULL_FEATURES)),
    Experiment("expA_pledge", tuple(PLEDGE_FEATURES)),
    Experiment("expB_full", tuple(PLEDGE_FEATURES + MARKET_FEATURES)),
    Experiment("ablation_static", tuple(STATIC_FEATURES + MARKET_FEATURES)),
    Experiment("expC_events", tuple(EVENT_FEATURES)),
    Experiment("expD_events_market", tuple(EVENT_FEATURES + MARKET_FEATURES)),
    Experiment("expE_everything", tuple(PLEDGE_FEATURES + EVENT_FEATURES + MARKET_FEATURES)),
    Experiment("expF_pledged_null", tuple(NULL_FEATURES), "pledged", "expF_pledged_null"),
    Experiment("expG_pledged_full", tuple(PLEDGE_FEATURES + MARKET_FEATURES), "pledged", "expF_pledged_null"),
    Experiment(
        "expH_pledged_events", tuple(PLEDGE_FEATURES + EVENT_FEATURES + MARKET_FEATURES),
        "pledged", "expF_pledged_null",
    ),
]


@dataclass(frozen=True)
class ModelSpec:
    """One estimator and its parameters, in MLlib terms."""

    name: str
    kind: str  # logreg | random_forest | boosted
    params: dict = field(default_factory=dict)
    search_space: dict = field(default_factory=dict)


# Estimator parameters; the order is simplest first and breaks ties in selection.
MODELS = [
    ModelSpec("logreg", "logreg", {"C": 1.0, "max_iter": 2000, "balanced": True}),
    ModelSpec("random_forest", "random_forest", {"n_estimators": 300, "max_depth": 8, "min_samples_leaf": 10}),
    ModelSpec(
        "xgboost", "boosted",
        {"max_depth": 3, "n_estimators": 400, "learning_rate": 0.04, "subsample": 0.8,
         "colsample_bytree": 0.8, "min_child_weight": 5},
        {"max_depth": [2, 3, 4], "n_estimators": [200, 300, 400, 600],
         "learning_rate": [0.02, 0.04, 0.06, 0.1], "subsample": [0.7, 0.8, 0.9],
         "colsample_bytree": [0.7, 0.8, 0.9], "min_child_weight": [3, 5, 10]},
    ),
]


@dataclass(frozen=True)
class Settings:
    windows: Windows = field(default_factory=Windows)
    evaluation: Evaluation = field(default_factory=Evaluation)
    min_train_dates: int = 8
    search_points: int = 20
    search_fold: int = 1
    search_model: str = "xgboost"
    headline: str = "expB_full"
    baseline: str = "exp0_null"
    metric: str = "within_quarter_auc"
    tie_tolerance: float = 0.0
    keep_sessions: int = 3
    winsor: tuple[float, float] = (0.01, 0.99)
    seed: int = 42

    def snapshot(self) -> str:
        """The whole configuration as one JSON string, stored with each run."""
        return json.dumps(asdict(self), sort_keys=True)
