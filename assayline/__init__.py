"""Laboratory-instrument analytics as PySpark DataFrame operators."""
