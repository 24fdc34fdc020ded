"""Inventory pipelines: census plot tables, the change panel, carbon and checks."""
