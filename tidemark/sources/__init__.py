"""Readers, file normalisers, adapters and sinks."""
