"""gondola: retail-catalogue analytics and corpus operators on Spark DataFrames."""
