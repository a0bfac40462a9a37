"""Inputs: table readers, the derived order stream, topic records and metric samples."""
