"""Reusable relational building blocks: histories, reshaping, statistics, sampling."""
