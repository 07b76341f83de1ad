"""Readers, writers and the view that turns a plain event table into a play log."""
