"""Sales-account analytics as PySpark DataFrame operators."""
