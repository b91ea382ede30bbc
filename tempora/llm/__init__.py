"""Training-data operators: one module per operator, plus ``queries`` that registers them.

Nothing outside this subpackage imports it; ``__spark_entry__.py`` adds its queries
only when it is present.
"""
