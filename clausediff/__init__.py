"""Spark jobs that compare two versions of contracts and statutes across a corpus."""
