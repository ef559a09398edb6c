"""Operators over the tables of a world and over hits."""
