"""Sensor-log analytics on Spark DataFrames: sources, operators, plans and audits."""
