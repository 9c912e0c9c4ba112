"""Tidewrack: literature discovery, record linkage and screening samples on PySpark."""
