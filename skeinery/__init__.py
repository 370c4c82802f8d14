"""Skeinery: a DataFrame-first engine for catalogues of discovered content.

Subpackages: ``sources`` (tables, feeds, sinks), ``functions`` (column and
text kernels), ``operators`` (catalogue, analytics, full text, vectors,
ranking, pipeline), ``plans`` (query registry and plan builders),
``streaming`` (Structured Streaming wiring).
"""
