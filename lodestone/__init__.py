"""Evidence analytics on Spark: document blocks, evidence records, vectors and corpus operators."""
