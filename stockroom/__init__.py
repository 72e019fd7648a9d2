"""Inventory analytics for serial-numbered parts, written for Spark."""
