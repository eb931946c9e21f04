"""Whole jobs: training, evaluation, reports, audits and the end-to-end run."""
