"""Relational, text, graph and evaluation operators over DataFrames."""
