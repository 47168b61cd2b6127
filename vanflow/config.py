"""Frozen configuration: keys, thresholds and clamps.

Every number below is a fixed value that results depend on; operators take the
whole dataclass so callers can replace single fields with ``dataclasses.replace``.
"""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class DemandConfig:
    """Panel, classification, feature and forecasting settings."""

    group_keys: tuple[str, ...] = ("RouteCode", "ItemCode")
    date_col: str = "TrxDate"
    target_col: str = "TotalQuantity"
    meta_cols: tuple[str, ...] = ("WarehouseName", "ItemName", "CategoryName")
    causal_cols: tuple[tuple[str, str], ...] = (("AvgUnitPrice", "mean"),)
    granularity: str = "D"
    max_inactivity_periods: int = 180
    test_horizon: int = 30
    validation_horizon: int = 30
    forecast_horizon: int = 30

    adi_threshold: float = 1.32
    cv2_threshold: float = 0.49
    iqr_multiplier: float = 3.0
    target_encoding_smoothing: float = 10.0
    weekend_days: tuple[int, ...] = (4,)
    custom_events: tuple[tuple[str, str, str], ...] = (
        ("covid_lockdown", "2020-03-01", "2021-12-31"),
    )

    lags: dict[str, tuple[int, ...]] = field(
        default_factory=lambda: {
            "smooth": (1, 7, 14, 21, 28),
            "intermittent": (7, 14, 28),
            "erratic": (1, 7, 14, 21, 28),
            "lumpy": (7, 14, 28),
        }
    )
    rolling_windows: tuple[int, ...] = (7, 14, 28)
    rolling_stats: dict[str, tuple[str, ...]] = field(
        default_factory=lambda: {
            "smooth": ("mean", "std", "min", "max", "median"),
            "intermittent": ("mean", "sum", "nonzero_ratio"),
            "erratic": ("mean", "std", "max"),
            "lumpy": ("mean", "std", "nonzero_ratio"),
        }
    )

    models: dict[str, tuple[str, ...]] = field(
        default_factory=lambda: {
            "smooth": (
                "naive", "moving_average", "ets", "linear", "random_forest",
                "leafwise_trees", "depthwise_trees", "ensemble",
            ),
            "intermittent": (
                "croston", "croston_sba", "naive", "moving_average", "two_stage",
            ),
            "erratic": (
                "moving_average", "random_forest", "leafwise_trees",
                "depthwise_trees", "ensemble", "two_stage",
            ),
            "lumpy": ("croston", "croston_sba", "two_stage", "moving_average"),
        }
    )
    fallback_models: tuple[str, ...] = ("moving_average", "naive")
    selection_metric: str = "rmse"
    moving_average_window: int = 7
    croston_alpha: float = 0.4
    ets_alphas: tuple[float, ...] = (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9)
    two_stage_threshold: float = 0.5
    interval_quantiles: tuple[float, float] = (0.1, 0.9)
    cv_splits: int = 3
    tuning_trials: int = 15
    seed: int = 42


@dataclass(frozen=True)
class Clamps:
    """Bounds around thresholds that are otherwise derived from each route's data."""

    freq_floor: tuple[float, float] = (0.02, 0.50)
    dormancy_days: tuple[int, int] = (30, 180)
    qty_benchmark: tuple[float, float] = (5.0, 500.0)
    completion_gate: tuple[float, float] = (0.30, 0.60)
    basket_confidence: tuple[float, float] = (0.30, 0.70)
    sparse_customer_ratio: float = 0.75
    sparse_relief: float = 0.5
    peer_k: tuple[int, int] = (5, 20)
    peer_floor: tuple[float, float] = (0.05, 0.50)
    peer_max: tuple[int, int] = (2, 8)
    peer_max_divisor: float = 10.0
    half_life: tuple[float, float] = (14.0, 180.0)
    tier_must: tuple[float, float] = (70.0, 95.0)
    tier_should: tuple[float, float] = (50.0, 80.0)
    tier_consider: tuple[float, float] = (30.0, 60.0)
    tier_monitor: tuple[float, float] = (10.0, 40.0)
    qty_center: tuple[float, float] = (0.85, 1.10)
    basket_top_k: int = 3
    seed_top_k: int = 5
    seed_qty: int = 5
    window_days: int = 90
    window_bounds: tuple[int, int] = (60, 180)
    fallback_min_days: int = 14
    fallback_min_customers: int = 5
    sanity_z: float = 3.0
    sanity_percentile: float = 0.95
    winsor_percentile: float = 0.95
    peer_min_customers: int = 3
    min_days_since_purchase: int = 1
    # weights at or below the frequency floor and at or above 0.5
    weights_low: tuple[float, float, float] = (0.30, 0.40, 0.30)
    weights_high: tuple[float, float, float] = (0.55, 0.25, 0.20)

    feedback_window_days: int = 30
    feedback_window_bounds: tuple[int, int] = (14, 180)
    feedback_ema_alpha: float = 0.3
    feedback_multiplier: tuple[float, float] = (0.5, 1.5)
    feedback_prior_divisor: float = 4.0
    feedback_adversarial_z: float = 3.0
    feedback_weak_source: float = 0.05


@dataclass(frozen=True)
class SupervisionConfig:
    """Visit scoring and redistribution limits."""

    perfect_low: float = 0.75
    perfect_high: float = 1.20
    max_over: float = 2.00
    coverage_weight: float = 0.40
    accuracy_weight: float = 0.60
    max_recipients: int = 5
    max_increase: float = 0.50
    tier_order: tuple[str, ...] = ("MUST_STOCK", "SHOULD_STOCK", "CONSIDER", "MONITOR")


@dataclass(frozen=True)
class DashboardConfig:
    """Thresholds of the accuracy, adoption and planning views."""

    tolerance: float = 0.20
    significant_share: float = 0.05
    trend_step_pp: float = 2.0
    at_risk_probability: float = 0.7
    drift_warn: float = 3.0
    drift_alert: float = 7.0
    min_demand_probability: float = 0.99
    rest_weekday: int = 4
    max_plan_days: int = 30


@dataclass(frozen=True)
class PromptLimits:
    """Row limits of the text tables."""

    items_per_customer: int = 12
    customers: int = 12
    van_items: int = 15
    items_per_block: int = 5


@dataclass(frozen=True)
class Splits:
    """How finely work on one hot key is spread over tasks."""

    hot_key_splits: int = 32
    similarity_block: int = 2048
    item_block: int = 512
    customer_chunk: int = 1024


DEMAND = DemandConfig()
CLAMPS = Clamps()
SUPERVISION = SupervisionConfig()
DASHBOARD = DashboardConfig()
PROMPTS = PromptLimits()
SPLITS = Splits()
