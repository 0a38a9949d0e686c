"""Whole plans: the scan pipeline, derived inputs on the supplied tables, and the query registry."""
