"""Inputs and outputs: declared schemas, file and catalog readers, writers, and the star-schema derivation."""
