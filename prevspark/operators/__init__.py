"""Transformers, methods, solvers and sampling protocols."""
