"""Retrieval plans and routing decisions as columns."""
