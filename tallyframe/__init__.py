"""Evaluation data on Spark: curate cases, check runs, score and compare them."""
