"""Quernstone: evidence corpora, retrieval and time series on PySpark."""
