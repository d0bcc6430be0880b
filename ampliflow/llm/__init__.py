"""Operators for preparing language-model training corpora.

Each module holds one operator with a general interface; ``queries`` applies them to whole tables.
Nothing outside this package imports it.
"""
