"""Classified-ad analytics as Spark jobs: every operator is a function from DataFrame to DataFrame."""
