"""Training-data operators: near and exact duplicates, licences, tokens, packing,
toxicity, URL verdicts, line-quality rules and chat rendering.

Nothing else in the library imports this package; ``queries.py`` registers its queries.
"""
