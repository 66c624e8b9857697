"""Continuous triage of arriving mail."""
