"""PySpark toolkit for map-reduce analytics: numeric statistics, word counts and k-median clustering."""
