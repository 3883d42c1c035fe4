"""orrery: link-graph census analytics as Spark DataFrame plans."""
