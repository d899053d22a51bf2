"""Change histories, validity periods, counters and visits as PySpark DataFrame operators."""
