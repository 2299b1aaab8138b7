"""Operators: store, features, design matrix, forecasters, scores, significance, explanations."""
