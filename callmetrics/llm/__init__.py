"""Operators for preparing training text at scale.

Nothing outside this package imports it. Each module holds one operator:
``mixing``, ``topk``, ``toxicity``, ``langid``, ``maxent``, ``licenses``,
``digest``, ``bpe``, ``sharding``, ``simhash``, ``fim``, ``tokencount`` and
``prefixtrie``; ``queries`` binds them to the documents, embeddings and conversations
tables, and ``pipeline`` holds the stages that make a corpus of documents.
"""
