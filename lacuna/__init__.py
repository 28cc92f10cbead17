"""lacuna: a Spark-first engine for incomplete, ordered sensor data."""
