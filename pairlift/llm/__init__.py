"""Operators for preparing language-model training text: see README, section "Training text"."""
