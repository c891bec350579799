"""Retrieval, evaluation and corpus analytics over dated text records, as Spark programs."""
