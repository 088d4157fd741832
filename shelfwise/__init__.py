"""Stock, sales and audit analytics as Spark DataFrame programs."""
