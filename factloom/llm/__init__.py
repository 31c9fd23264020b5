"""Training-data operators: thirteen dealt operators, each a function of DataFrames, and their thin registered queries.

Nothing else in factloom imports this package.
"""
