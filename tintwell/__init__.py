"""Colour, coverage and dot analytics over catalogues of images held as Spark tables."""
