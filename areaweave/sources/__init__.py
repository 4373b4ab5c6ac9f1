"""Readers and writers. File formats without a Spark reader are read on the driver or, where large, on executors."""
