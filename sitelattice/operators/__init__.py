"""Relational operators: extraction, crawling, selection, deduplication, jobs and summaries."""
