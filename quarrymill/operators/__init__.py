"""Operators on whole tables: links, records, gates, operations history."""
