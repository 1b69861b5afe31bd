"""End-to-end scans composed from the operators."""
