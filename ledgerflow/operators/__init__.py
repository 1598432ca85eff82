"""Account-day risk on Spark: operators."""
