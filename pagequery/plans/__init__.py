"""From a config to DataFrames."""
