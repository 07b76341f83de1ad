"""Whole computations: session summaries, features, hold-outs, models, metrics."""
