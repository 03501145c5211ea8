"""Operators for large-scale training-data pipelines (the ``llm`` subpackage).

Nothing else in the library imports this package.  Each module states its method, the
defined result of every edge case, and what is bounded by which parameter.
"""
