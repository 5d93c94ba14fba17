"""Whole plans: the end-to-end selection and the registered queries with their SQL."""
