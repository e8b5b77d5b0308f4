"""pulsegrid: physiological time-series analytics as Spark DataFrame operators."""
