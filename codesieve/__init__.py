"""Spark jobs for code-scan data: corpora, chunks, findings, scores; and training-data operators in `llm`."""
