"""quire: document slicing, catalog maintenance and text analytics on Spark DataFrames."""
