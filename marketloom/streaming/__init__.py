"""Structured Streaming versions of the operators that keep state; each agrees with its batch version on the same rows."""
