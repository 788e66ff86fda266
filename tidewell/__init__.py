"""tidewell: content intelligence and analytics as plain Spark jobs."""
