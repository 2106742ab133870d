"""voxelore: spatial graph analytics over clouds of Gaussian primitives, on Spark DataFrames."""

__version__ = "0.1.0"
