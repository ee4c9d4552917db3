"""Spark-native operators for building biodiversity image datasets.

Every operator takes and returns DataFrames (or Columns); nothing here
collects table data to the driver.
"""
