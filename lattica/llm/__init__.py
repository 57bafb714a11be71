"""Operators for preparing training data; nothing else in lattica imports this subpackage."""
