"""Operators for preparing training corpora, each with its registered query.

Nothing outside this subpackage imports it; ``__spark_entry__`` adds its
queries when the subpackage is present.
"""
