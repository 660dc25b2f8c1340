"""Relational operators: from parsed files to instances, frames, pixels and rendered images."""
