"""vacatlas: job-market analytics as Spark DataFrame operators."""
