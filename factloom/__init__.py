"""Part of factloom: financial-report facts on Spark DataFrames."""
