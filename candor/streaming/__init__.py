"""Operators on streams, and resumption of partly finished work."""
