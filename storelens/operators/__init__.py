"""Relational operators: audit, mart building, KPIs, descriptive, diagnostic and customer analyses."""
