"""Relational operators over instruction, block and edge tables."""
