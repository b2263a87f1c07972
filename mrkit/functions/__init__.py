from mrkit.functions.text import split_words
from mrkit.functions.vectors import euclidean, parse_vector

__all__ = ["euclidean", "parse_vector", "split_words"]
