"""Operators for preparing large text corpora; nothing else in docloom imports this subpackage."""
