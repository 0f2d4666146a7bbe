"""tamarack: catalog search, topic search and their upkeep as lazy Spark DataFrames."""
