"""A property-graph analytics engine built on Spark DataFrames."""
