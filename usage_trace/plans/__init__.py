"""Declarative language specs and the plans made from them."""
