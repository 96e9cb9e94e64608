"""Operators for preparing training text: sharding, de-duplication, decontamination, scoring, tokens, archives."""
