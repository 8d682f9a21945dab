"""Operators of a training-data pipeline over the tables documents and labels.

Nothing else in the library imports this subpackage. One module holds one operator; queries.py holds
the registered queries.
"""
