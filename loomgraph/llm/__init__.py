"""Training-data operators: one module per operator, queries in :mod:`loomgraph.llm.registry`.

Nothing outside this folder, ``tests/llm`` and ``corpus_pipeline.py`` imports it.
"""
