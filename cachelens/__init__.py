"""cachelens: cache-workload analytics and training-data operators on Spark DataFrames."""
