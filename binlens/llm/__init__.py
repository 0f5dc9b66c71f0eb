"""Operators of a training-data pipeline over text corpora.

Thirteen operators (exact dedup, language-model scoring, line dedup, sharding, SimHash
near-dedup, token files, source mixing, quality classifier, benchmark decontamination,
language identification, fill-in-the-middle examples, spelling variants, byte-level BPE), each with its own general interface. ``queries`` binds them to
the ``documents`` table; ``corpus_pipeline.py`` at the top of the repository chains five.
"""
