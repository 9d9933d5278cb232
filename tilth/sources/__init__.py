"""Inputs: the published comparison, and geographic coordinates."""
