"""Whole plans: outputs, requests and audits from source to result."""
