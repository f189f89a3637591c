"""strideframe: bulk analysis of walking and running networks on Spark DataFrames."""
