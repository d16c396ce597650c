"""Operators for text corpora: history deduplication, canonical values, splitting, near-duplicates, tokens, mixing, normal forms.

Nothing outside this folder and its tests imports it.
"""
