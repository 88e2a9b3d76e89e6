"""Readers and writers: raw files and payload tables in, long tables out."""
