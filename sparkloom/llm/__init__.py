"""Operators that prepare training text: conversations, pieces, token ids, leaks, quality and nearest vectors."""
