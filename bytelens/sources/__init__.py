"""Readers and writers: the DEX container, class text directories."""
