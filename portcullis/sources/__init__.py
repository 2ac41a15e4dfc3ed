"""Readers and writers: tables, audit logs, policies, artifacts."""
