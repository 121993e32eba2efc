"""Operators for preparing language-model training data.

Common conventions: input frames may hold further columns of any name; operators read only the columns
they name. A null text counts as the empty text, repeated rows are kept as rows of their own, and an
empty table gives an empty result with the same columns.
"""
