"""Spark jobs for speech-practice data."""
