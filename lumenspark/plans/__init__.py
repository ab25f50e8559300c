"""Logical building blocks shared by the operators."""
