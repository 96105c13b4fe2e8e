"""Scalar helpers and session plumbing shared by every operator."""
