"""treeloom: markup queries and data preparation as Spark DataFrame plans."""
