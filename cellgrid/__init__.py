"""cellgrid: gridding of scattered observations on the sphere, expressed in Spark DataFrames."""

__version__ = "0.1.0"
