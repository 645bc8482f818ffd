"""Whole jobs: extract, analyze, lower-bound census, log mining."""
