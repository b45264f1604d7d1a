"""Operators over streams, with batch twins."""
