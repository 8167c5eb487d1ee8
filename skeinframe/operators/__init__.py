"""Frames: lazy and eager operators, joins, grouping."""
