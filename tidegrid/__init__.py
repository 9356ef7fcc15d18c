"""tidegrid: geo-temporal event analytics as Spark DataFrame operators."""
