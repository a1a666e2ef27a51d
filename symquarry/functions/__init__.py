"""Scalar functions: Column expressions and their small Python counterparts."""
