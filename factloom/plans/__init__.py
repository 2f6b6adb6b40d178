"""Registered queries beside their SQL. Importing the package registers all of them in ``catalogue``."""

from . import catalogue, deeper, further

__all__ = ["catalogue", "deeper", "further"]
