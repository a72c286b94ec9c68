"""Training-data pipeline operators.

Self-contained: nothing else in the library imports this subpackage.
"""
