"""Capture-evidence analytics as plain ``DataFrame -> DataFrame`` operators."""
