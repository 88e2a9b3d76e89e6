"""Training-data operators: archives, quality, licences, tokens, near copies, benchmark leaks, chat and packing.

Nothing outside this folder imports it, apart from the guarded lines of ``__spark_entry__.py`` and ``corpus_pipeline.py``.
"""
