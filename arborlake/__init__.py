"""Content-addressed tree data as DataFrames."""
