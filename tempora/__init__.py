"""Signal temporal logic over time-series tables, compiled to Spark DataFrame plans."""
