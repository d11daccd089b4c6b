"""Scans, sinks, inventories and landing plans."""
