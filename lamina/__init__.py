"""Volumetric analytics as Spark jobs: masks, contours, paths, skeleton graphs and pyramids."""
