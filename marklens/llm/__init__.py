"""Training-data operators: ten Spark jobs over text, vectors and web pages.

Nothing outside this subpackage imports it.
"""
