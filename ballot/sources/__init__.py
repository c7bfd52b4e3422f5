"""Vector tables and stored models."""
