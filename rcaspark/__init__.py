"""Incident root-cause analysis over metrics, logs and text, as Spark DataFrame jobs."""
