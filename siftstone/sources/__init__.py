"""Readers and writers: source trees, suites, rules, manifests, logs, tables."""
