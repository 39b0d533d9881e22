"""Query shapes built from the operators: dispatch, windows, reports."""
