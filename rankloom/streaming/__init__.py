"""Streaming surface.

There is no source, trigger, window or state of its own to rebuild here: every
workload reads whole tables.  The stateless operators (projections, filters,
scalars and joins against static dimensions) take a streaming DataFrame as it is;
`tests/test_streaming.py` runs a few of them that way.
"""
