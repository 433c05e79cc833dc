"""Named data products: functions from input DataFrames to a result DataFrame."""
