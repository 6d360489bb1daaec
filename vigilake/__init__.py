"""vigilake: vulnerability and web-threat analytics as Spark DataFrame jobs."""
