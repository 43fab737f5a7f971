"""tipflow package."""
