"""Operators: plain functions, DataFrame in, DataFrame out."""
