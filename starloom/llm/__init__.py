"""Training-data operators: language, mixing, quality, decontamination, tokens, dedup, secrets, archives, fingerprints.

Nothing outside this package imports it; its queries are listed in ``starloom.llm.queries``.
"""
