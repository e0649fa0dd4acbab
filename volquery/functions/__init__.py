"""Axis arithmetic and scalar column functions."""
