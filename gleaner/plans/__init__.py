"""Whole runs and the command line."""
