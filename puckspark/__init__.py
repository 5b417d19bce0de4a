"""Sports-statistics analytics as PySpark DataFrame functions."""
