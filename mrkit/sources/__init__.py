from mrkit.sources.lines import read_lines
from mrkit.sources.partitions import spread_scan
from mrkit.sources.text import numbers_from_lines, read_documents, read_numbers, read_vectors

__all__ = ["numbers_from_lines", "read_documents", "read_lines", "read_numbers", "read_vectors", "spread_scan"]
