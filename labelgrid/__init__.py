"""Label volumes, hierarchies, skeletons and signals as Spark DataFrames."""
