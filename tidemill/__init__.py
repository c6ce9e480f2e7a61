"""A news- and content-intelligence engine on Spark DataFrames."""
