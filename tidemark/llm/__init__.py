"""Operators for preparing language-model training data.

Each module holds one operator with a general interface (id and text columns
are parameters); ``queries`` applies them to the ``documents`` table with
production parameters. Nothing outside this folder imports it.
"""
