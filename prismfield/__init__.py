"""Sensor-survey fusion and thermal analytics as PySpark DataFrame programs."""
