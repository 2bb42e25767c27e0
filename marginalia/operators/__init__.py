"""Operators over papers, reviews, links and event logs."""
