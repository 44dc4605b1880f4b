"""Reports and end-to-end jobs composed from the operators."""
