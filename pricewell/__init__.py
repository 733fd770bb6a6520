"""Retail-offer analytics as pure DataFrame transforms on Apache Spark."""
