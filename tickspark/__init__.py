"""Spark jobs for market-data research: bars, features, labels, training sets, backtests."""
