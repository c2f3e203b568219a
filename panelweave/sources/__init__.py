"""Readers, writers and audits for the file formats the jobs consume."""
