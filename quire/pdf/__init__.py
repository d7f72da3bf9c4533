"""Kernels that read and write single PDF files. Spark code calls them once per file."""
