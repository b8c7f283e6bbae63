"""Source-line accounting and corpus preparation on Spark."""
