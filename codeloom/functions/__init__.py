"""Part of codeloom; see the package docstring."""
