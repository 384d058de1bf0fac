"""Operators of a training-data pipeline: sharding, fingerprints, mixing, filters, encoding.

Nothing else in the library imports this package. Python functions that run inside tasks live
in these modules, so executors need the package on their path.
"""
