"""Event-graph and time-series data processing as plain DataFrame functions on Spark."""
