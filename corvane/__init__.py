"""Corvane: document collections to structured, dialogue-ready data, as DataFrame operators."""
