"""Relational, graph, full-text and vector queries over one data model, as DataFrame plans."""
