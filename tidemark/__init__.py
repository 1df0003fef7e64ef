"""Table migration, change-log apply and verification as Spark jobs."""
