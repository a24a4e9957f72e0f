"""Readers and writers of asset folders, prompt libraries and containers."""
