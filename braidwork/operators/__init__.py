"""The stages' operators on DataFrames."""
