"""Billing analytics for satellite data services, written as DataFrame-to-DataFrame functions."""
