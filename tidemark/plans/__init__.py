"""The registered queries. Importing this package fills the registry."""

from tidemark.plans import book_queries, committee_queries, instrument_queries, listing_queries, outcome_queries, plan_queries, report_queries, rule_queries, sizing_queries, source_queries, stream_queries, timeseries_queries, universe_queries, validation_queries  # noqa: F401
