"""Operators on documents: leaked evaluation texts, mixing by source, reading level."""
