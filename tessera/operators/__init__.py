"""Relational operators on genomic intervals, chains and counts."""
