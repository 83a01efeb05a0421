"""Inputs: generated ranges and matrices in text files."""
