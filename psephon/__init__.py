"""psephon: a Spark-first engine for long-format survey, contest and series data."""
