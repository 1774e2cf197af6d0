"""Content addressing for Spark: canonical forms, labels and what is built on them."""
