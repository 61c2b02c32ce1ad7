"""Back-testing of transaction-monitoring rules on Spark."""
