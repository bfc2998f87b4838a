"""Sales-transaction analytics on Spark: ingestion, period analytics, baskets and daily forecasts."""
