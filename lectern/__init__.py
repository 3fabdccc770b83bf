"""lectern: scholarly-metadata analytics as lazy, composable PySpark DataFrame operators."""
