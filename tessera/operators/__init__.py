"""Kernels over DataFrames."""
