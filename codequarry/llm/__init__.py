"""Operators over the text of training data. Nothing outside this subpackage imports it."""
