"""Spark-native operators for keyed time-series panels.

Every public function takes and returns DataFrames and stays lazy; the physical
strategy is left to Catalyst and adaptive execution.  See README.md for the design.
"""
