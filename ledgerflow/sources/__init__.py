"""Account-day risk on Spark: sources."""
