"""Relational operators: grids, scores, aggregates, quantiles, interpolation."""
