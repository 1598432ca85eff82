"""Account-day risk on Spark: jobs."""
