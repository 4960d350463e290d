"""Search requests as rows."""
