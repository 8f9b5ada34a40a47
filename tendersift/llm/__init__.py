"""Operators of a large-scale training-data pipeline.

Nothing outside this subpackage imports it.  Every operator is a function from
DataFrame to DataFrame; Python that runs inside tasks works on one Arrow batch
at a time and keeps no state that grows with the input.
"""
