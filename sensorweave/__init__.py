"""Sensor-panel analytics on Spark: operators, sources, functions, plans, streaming."""
