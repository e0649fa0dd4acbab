"""Structured Streaming: emit-when-complete stitching and periodic sampling."""
