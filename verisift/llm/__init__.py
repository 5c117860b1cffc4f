"""Training-data preparation operators.

A self-contained subpackage: nothing else in the library imports it. Each
operator module holds one operator with its own general interface;
``registry`` holds the thin queries and their SQL.
"""
