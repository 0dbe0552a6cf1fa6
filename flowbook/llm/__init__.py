"""Operators of a training-data pipeline over the tables ``documents``, ``pages``,
``benchmark``, ``labels`` and ``conversations``.  Nothing else in the library
imports this package."""
