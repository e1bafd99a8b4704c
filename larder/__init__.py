"""Retail demand and replenishment analytics as DataFrame-to-DataFrame functions on Spark."""
