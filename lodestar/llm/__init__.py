"""Training-data operators: ten large-scale text, page and vector jobs.

Nothing outside this subpackage imports it; ``__spark_entry__.py`` adds its
queries only where it is present.
"""
