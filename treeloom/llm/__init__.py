"""Operators for preparing large training corpora; nothing else in treeloom imports this package."""
