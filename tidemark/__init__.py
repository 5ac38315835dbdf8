"""Longitudinal analytics as Spark DataFrame programs."""
