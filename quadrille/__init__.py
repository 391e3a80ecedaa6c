"""Quadrille: spatial and corpus analytics expressed as PySpark DataFrame plans."""
