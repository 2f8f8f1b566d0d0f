"""folioflow: DataFrame operators for hierarchical document corpora on PySpark."""
