"""Quantized vector search and data preparation as Spark DataFrame plans."""
