"""Search operators over DataFrames."""
