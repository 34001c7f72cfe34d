"""issq: in-situ sequencing analytics on Spark DataFrames."""
