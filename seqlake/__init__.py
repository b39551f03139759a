"""Analytics over sequenced logs, on Spark."""
