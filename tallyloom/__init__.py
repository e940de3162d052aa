"""Analytics operators for transaction tables, written as plain Spark DataFrame functions."""
