"""Station-flow analytics as plain PySpark DataFrame functions."""
