"""Waybill: logistics analytics as PySpark DataFrame transformations."""
