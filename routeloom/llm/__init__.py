"""Operators for preparing training corpora.

Nothing outside this package imports it; the registry of the repository adds
its queries only when the package can be imported.
"""
