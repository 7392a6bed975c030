"""crestline: outdoor-route catalogue analytics as Spark DataFrame jobs."""
