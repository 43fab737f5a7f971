"""Training-data operators: the ten dealt operators and their registered queries.

Nothing else in the library imports this package; ``__spark_entry__`` adds its
queries only when it is present.
"""
