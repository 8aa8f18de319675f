"""gapline: equipment reliability analytics as PySpark DataFrame operators."""
