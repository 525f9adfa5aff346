"""Published views, the audit report, and the query registry with its reference SQL."""
