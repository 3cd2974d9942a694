"""Report plans, grouped by the subject they report on."""
