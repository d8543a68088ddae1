"""Scalar functions as Catalyst expressions: text, money, addresses, places, labels."""
