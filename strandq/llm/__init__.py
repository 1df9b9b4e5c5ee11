"""Operators for preparing language-model training data.  Nothing else in strandq imports this subpackage."""
