"""Operators for preparing large training corpora, with their registered queries."""
