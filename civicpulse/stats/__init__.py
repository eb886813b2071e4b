"""Estimators: Spark reduces to cross-products or small panels, NumPy solves."""
