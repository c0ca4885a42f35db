"""prismar: media similarity analytics on Spark DataFrames."""
