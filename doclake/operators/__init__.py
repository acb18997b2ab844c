"""Relational operators over typed blocks, libraries, trees, graphs, jobs and evaluations."""
