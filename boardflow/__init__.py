"""Boardflow: clean, link and analyse noisy readings of ranked lists with PySpark."""
