"""roadpulse: road-congestion analytics over driver GPS events, built on Spark DataFrames."""
