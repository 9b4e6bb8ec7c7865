"""Composed workflows: raw census to panel, panel to ranked models."""
