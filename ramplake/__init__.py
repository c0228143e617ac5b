"""Event-process analytics on power and weather time series, written as Spark DataFrame operators."""
