"""Readers and writers of facts and external evidence."""
