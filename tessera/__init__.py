"""Tessera: causal structure learning and graph analytics on Spark DataFrames."""
