"""Sparse, low-rank and hierarchical linear algebra, spatial clustering and corpus preparation as Spark DataFrame plans."""
