"""Training-data operators: search, token counts, licences, scoring, deduplication, mixing.

Nothing outside this folder imports it.
"""
