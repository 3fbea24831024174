"""DataFrame operators over registries, toxicity values, annotations and reports."""
