"""Curation of labelled classification datasets and evaluation of classifiers, on Spark DataFrames."""
