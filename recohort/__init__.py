"""Cohort, retention and event-time analytics as composable Spark DataFrame operators."""
