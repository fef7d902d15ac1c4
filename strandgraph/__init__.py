"""Graph analytics on compressed adjacency lists, as Spark DataFrames."""
