"""The registered queries: each beside its SQL."""
