"""Grouped predictive modelling on the feature table: splits, metrics, nulls, intervals, estimators."""
