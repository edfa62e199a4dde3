"""Market-bar analytics and backtests as Spark DataFrame jobs."""
