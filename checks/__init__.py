"""Round-trip checks: reports rendered from the test tables, and SQL that says what must come out."""
