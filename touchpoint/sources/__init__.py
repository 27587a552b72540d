"""Logical table schemas, production readers and the driver-table adapters."""
