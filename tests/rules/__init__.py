"""Operators on rows that exercise each rule; the SQL states what must come out."""
