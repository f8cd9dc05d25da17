"""Operators for preparing training text: archives, deduplication, decontamination, tokens, models.

Nothing outside this package imports it. The registered queries are in :mod:`.catalog`.
"""
