"""Whole flows: curation, text-output evaluation, feature evaluation, and the views over the test tables."""
