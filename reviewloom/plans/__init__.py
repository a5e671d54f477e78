"""Composite jobs: prompts, reviews and fixes."""
