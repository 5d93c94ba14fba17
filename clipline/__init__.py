"""Clipline: interval, sequence and ranking operators over word-timed text and media timelines."""
