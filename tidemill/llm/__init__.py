"""Operators for training-data pipelines: toxicity, secrets, decontamination, BPE, deduplication, token files, URL and licence filters.

Nothing outside this subpackage imports it. Each module holds one operator with a general interface; ``queries`` binds
them to the tables of the driver with production parameters.
"""
