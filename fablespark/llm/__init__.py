"""Operators for preparing language-model training data.

Nothing outside this folder imports it, except the driver entry file and the
corpus pipeline at the top of the repository.
"""
