"""Subpackage of logloom."""
