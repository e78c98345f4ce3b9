"""Training-data operators: one module per operator, and the queries that apply them.

Nothing else in the package imports this one.
"""
