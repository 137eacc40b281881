"""Operators for preparing language-model training data.  Nothing outside this
subpackage imports it, so the folder can be removed as a whole."""
