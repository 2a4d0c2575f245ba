"""Analytics over automated-test runs, written as plain Spark DataFrame jobs."""
