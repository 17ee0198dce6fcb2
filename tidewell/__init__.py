"""Tidewell: engineering-evidence and text analytics on PySpark."""
