"""Analytics of court-tracking tables on Spark."""
