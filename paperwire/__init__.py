"""paperwire: a literature digest built from Spark DataFrames.

Landed records of several scholarly sources become one ``Paper`` table, which is
narrowed, numbered, given keywords, rendered for chat channels and written to an
outbox.  Every step is a lazy DataFrame transformation.
"""
