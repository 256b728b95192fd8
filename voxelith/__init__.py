"""Segmentation analytics over labelled volumes and their graphs, on Spark DataFrames."""
