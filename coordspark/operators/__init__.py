"""Transforms and predictors over labelled frames."""
