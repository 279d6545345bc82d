"""Analytics for networks of measuring stations, as Spark DataFrame operators."""
