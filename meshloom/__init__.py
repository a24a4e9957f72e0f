"""Curation of labeled 3D-asset libraries as Spark jobs."""
