"""DataFrame jobs for explainable genome annotation on Spark."""
