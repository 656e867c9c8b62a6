"""Helpers that shape physical plans: staged tables, sized broadcasts, sessions."""
