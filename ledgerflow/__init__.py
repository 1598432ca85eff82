"""Account-day risk on Spark: package."""
