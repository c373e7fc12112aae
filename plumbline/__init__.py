"""Plumbline: data valuation and frontier tracking over large tables, on Spark."""
