"""bloomtide: seasonal exposure analytics for many stations, on Spark DataFrames."""
