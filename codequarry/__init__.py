"""Spark-first analytics over source-code corpora: scans, unit extraction, call
graphs, slices, contexts, prompts, execution logs and their evaluation."""

__version__ = "0.1.0"
