"""Emission accounting on Spark: DataFrame-in / DataFrame-out reports and jobs."""
