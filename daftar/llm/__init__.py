"""Operators for building training corpora from documents, vectors and web pages."""
