"""Distinct-count sketches and the relational operators beside them."""
