"""Table layouts and column contracts."""

from __future__ import annotations

KEYS, ORDER = ("symbol",), "ts"

# The column contracts.
FEATURE_COLUMNS = (
    "open", "high", "low", "close", "log_return",
    "SMA_21", "SMA_50", "SMA_100", "SMA_200", "volatility_20",
    "bar_dynamics", "return_lag_1", "dynamics_lag_1", "return_lag_2",
    "dynamics_lag_2", "return_lag_3", "dynamics_lag_3", "day_sin", "day_cos",
    "month_sin", "month_cos", "ATR_14", "BB_width", "yield_differential",
)
LAG_COLUMNS = ("return_lag_1", "dynamics_lag_1", "return_lag_2", "dynamics_lag_2", "return_lag_3", "dynamics_lag_3")
BAR_COLUMNS = ("open", "high", "low", "close", "tick_volume")

BARS = "symbol string, ts timestamp_ntz, open double, high double, low double, close double, tick_volume double"
SERIES = "series_id string, ts timestamp_ntz, value double"
LEDGER = "symbol string, as_of_date date, forecasting_date date, as_of_close double, pred_direction string, pred_return_pct double, pred_confidence double, members map<string,string>, logged_at timestamp"
RUNS = "run_name string, logged_at timestamp, params map<string,string>, metrics map<string,double>"


def inputs(columns: list[str]) -> list[str]:
    """Of a prepared matrix's columns those that models see: the contract's without the lags, and the components in their place."""
    return [c for c in columns if c in FEATURE_COLUMNS or c.startswith("lag_pca_")]
