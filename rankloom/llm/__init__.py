"""Operations of a training-data pipeline.  Importing fills QUERIES and SQL.

Nothing else in the library imports this package; it may be removed with `corpus_pipeline.py`."""

from __future__ import annotations

from rankloom.llm.registry import QUERIES, SQL  # noqa: F401
from rankloom.llm import (bpe, chat, decontaminate, divergence, jaccard, language, negatives, pii, secrets, sketch, tokenfile,  # noqa: F401
                          urls, warc)
