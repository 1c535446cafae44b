"""Corpus preparation operators for language-model training data.

Nothing else in the library imports this subpackage; its queries and their SQL
are in :mod:`auditweave.llm.queries`.
"""
