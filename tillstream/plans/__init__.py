"""Analytical queries over the warehouse, the hot table and the forecasts."""
