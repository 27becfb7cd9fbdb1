"""Quern: content-addressed storage analytics and columnar encodings on Spark."""
