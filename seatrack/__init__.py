"""Vessel-trajectory analytics as plain DataFrame -> DataFrame functions on Spark."""
