"""Spark analytics for instrument panels: signals, prices, holders, reviews, books."""
