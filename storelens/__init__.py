"""storelens: commerce catalogue, product search and chat analytics on Spark.

Every operator is a function from DataFrames (plus plain arguments) to a
DataFrame.  Nothing is collected to the driver except where noted (the one
query vector of ``embed_query``).
"""

__version__ = "0.1.0"
