"""Compositions of operators: training, evaluation, reports."""
