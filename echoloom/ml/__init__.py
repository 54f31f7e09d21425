"""Classifiers over feature tables on spark.ml, and small exact models for feature search."""
