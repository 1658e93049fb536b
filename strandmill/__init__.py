"""Strandmill: a Spark-first engine for metadata tables, sequences and trees."""
