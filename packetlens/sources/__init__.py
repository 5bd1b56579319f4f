"""Captures, lists and intelligence responses in; result tables out."""
