"""netweave: connectivity queries over layered rectilinear layouts, on Spark DataFrames."""
