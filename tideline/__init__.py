"""Panel time-series analytics on Spark: bars, features, diagnostics, chronological learning, forecasts."""
