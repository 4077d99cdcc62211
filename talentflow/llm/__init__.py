"""Operators for preparing training data: decontamination, quality and language
models, URL rules, subword sampling, near-duplicate joins, line templates,
language-model scoring, vector near-duplicates and token counts.

Nothing outside this subpackage imports it.
"""
