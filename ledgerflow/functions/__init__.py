"""Account-day risk on Spark: functions."""
