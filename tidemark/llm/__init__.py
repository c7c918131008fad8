"""Operators of a training-data pipeline over text, media and conversations.

Nothing else in the library imports this subpackage. ``queries`` holds the
registered queries, the other modules one operator each.
"""
