"""Readers and writers for work orders, modelling tables, models and run logs."""
