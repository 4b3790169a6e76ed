"""Spark jobs that estimate, score and compare the make-up of bulk mixtures."""
