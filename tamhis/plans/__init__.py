"""Whole jobs built from the operators: cleaning, topics, classification."""
