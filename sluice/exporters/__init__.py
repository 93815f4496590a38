"""Sections of the result document, audit sheets and reports."""
