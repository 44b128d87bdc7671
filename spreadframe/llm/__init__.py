"""Operators for preparing language-model training data.

The modules here stand alone: nothing else in the library imports them.
"""
